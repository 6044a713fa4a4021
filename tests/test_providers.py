import pytest

from tidemark.providers import Asks, Collected, answer_deltas, interleaved


class Model:
    def __init__(self, pieces, error=None):
        self.pieces, self.error = pieces, error

    def answer(self, question, context):
        yield from self.pieces
        if self.error:
            raise RuntimeError(self.error)


def asked(asks, request, model, context=((1, "x"),)):
    return asks.start(request, lambda cancelled: answer_deltas(model, "q", list(context), cancelled))


def test_two_answers_at_once_of_which_one_is_cancelled():
    asks, model, got = Asks(), Model(["a", "b", "c"]), []
    for delta in interleaved([asked(asks, "one", model), asked(asks, "two", model)]):
        got.append(delta)
        if delta == ("two", "token", "b"):
            assert asks.cancel("one")
    assert got == [("one", "token", "a"), ("two", "token", "a"), ("one", "token", "b"), ("two", "token", "b"), ("one", "cancelled", None), ("two", "token", "c"), ("two", "citation", 1), ("two", "done", None)]
    assert not asks.cancel("one") and not asks.cancel("two") and not asks.cancel("never")


def test_a_new_request_takes_the_place_of_the_one_before():
    asks = Asks()
    first = asked(asks, "id", Model(["a", "b"]))
    assert next(first) == ("id", "token", "a")
    second = asked(asks, "id", Model(["x"]))
    assert list(first) == [("id", "cancelled", None)]
    assert [kind for _, kind, _ in second] == ["token", "citation", "done"] and not asks.cancel("id")
    late = asked(asks, "late", Model(["only"]))
    assert next(late) == ("late", "token", "only") and asks.cancel("late") and list(late) == [("late", "cancelled", None)]


def test_an_answer_as_a_summary():
    model = Model(["<think>hm</think>one ", "two"])
    assert Collected(model).summarise("p", [(3, "a"), (4, "b"), (3, "c")], 10) == ("one two", [3, 4])
    with pytest.raises(RuntimeError, match="no memory"):
        Collected(Model(["a"], "no memory")).summarise("p", [], 10)
