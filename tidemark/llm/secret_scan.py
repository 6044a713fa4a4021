"""Secret scans: rules, and a character convolutional network over every candidate and its context.

Rules find assignments of a named secret, access key ids and long hex runs. Candidates are those and all
other long tokens, with or without digits, and what is left of tokens around findings of the rules. A
small network reads the characters of a candidate and of the text around it, the whole of a longer one in
overlapping parts; it is trained on labelled findings, its scores are calibrated on others, and the
threshold is the highest that keeps a given recall on them. Findings of the rules stay whatever the
network says; it adds spans of kind ``model``.

The labelled findings come from a seeded generator (keys, tokens and hashes in many notations against
numbers, names, paths and long words), so training is bounded, repeatable and needs no table.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, text_or_empty

#: The rules' patterns and least lengths, in the order of the kinds.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN_LEAST = 6
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")

#: Every access key id and hex run lies within such a token.
TOKEN = re.compile("[A-Za-z0-9+/_.=-]{16,}")
LEAST = 16

#: Characters left of a candidate, of the candidate, and right of it that the network reads.
LEFT, INSIDE, RIGHT = 24, 48, 16

#: Characters from one part of a longer candidate to the next.
STEP = 8
WIDTH = LEFT + INSIDE + RIGHT
FILTERS, SPAN, EMBEDDED, HIDDEN, LETTERS = 24, 5, 12, 16, 98


def assignments(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping assignments whose value is long enough."""
    lower = text.lower()
    if len(lower) != len(text):  # one letter becomes two in lower case
        lower = text.replace("İ", "I").lower()
    at = []
    for name in ASSIGN_NAMES:
        k = lower.find(name)
        while k >= 0:
            at.append(k)
            k = lower.find(name, k + 1)
    out, end = [], 0
    for k in sorted(at):
        if k >= end and (m := ASSIGN.match(text, k)):
            end = m.end()
            if m.end(1) - m.start(1) >= ASSIGN_LEAST:
                out.append((k, end))
    return out


def candidates(text: str) -> list[tuple[int, str, int, int]]:
    """``(kind's place, kind, start, end)`` of the rules' findings and of all other candidates (kind model)."""
    out = [(0, "assign", a, b) for a, b in assignments(text)]
    known = [(a, b) for _, _, a, b in out]
    for m in TOKEN.finditer(text):
        token, at = m.group(), m.start()
        own = [(1, "access", at + x.start(), at + x.end()) for x in ACCESS.finditer(token)] if "AKIA" in token else []
        if len(token) >= 24:
            own += [(2, "hex", at + x.start(), at + x.end()) for x in HEX.finditer(token)]
        out += own
        for a, b in rest(at, m.end(), [(x[2], x[3]) for x in own] + [(a, b) for a, b in known if a < m.end() and at < b]):
            if text[a] == "=" and a > at:  # the sign between a finding and what is left
                a += 1
            if b - a >= LEAST:
                out.append((3, "model", a, b))
    return sorted(out, key=lambda x: (x[2], x[0]))


def rest(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a span without others."""
    out = []
    for a, b in sorted(spans):
        if a > start:
            out.append((start, a))
        start = max(start, b)
    return out + [(start, end)] if end > start else out


def views(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The candidate itself and, if it is longer than the network reads, overlapping parts up to its end."""
    if b - a <= INSIDE:
        return [(a, b)]
    starts = {*range(a, b - INSIDE, STEP), b - INSIDE, *(m.end() for m in re.compile("=").finditer(text, a, b - LEAST))}
    return [(a, b), *((k, min(b, k + INSIDE)) for k in sorted(starts))]


def windows(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Codes of the characters around and in each span, and 1 where they belong to it."""
    codes = np.zeros((len(spans), 2, WIDTH), np.int64)
    for row, (a, b) in zip(codes, spans):
        before, inside, after = text[max(0, a - LEFT) : a], text[a : min(b, a + INSIDE)], text[b : b + RIGHT]
        joined = before + inside + after
        at = LEFT - len(before)
        raw = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        row[0, at : at + len(raw)] = np.where((raw >= 32) & (raw < 127), raw - 30, 1)
        row[1, LEFT : LEFT + len(inside)] = 1
    return codes


class Network:
    """Embedding, one convolution, maxima over the candidate and over everything, one hidden layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        channels = EMBEDDED + 1
        self.p = {
            "embed": rng.normal(0, 0.5, (LETTERS, EMBEDDED)),
            "conv": rng.normal(0, (2 / (SPAN * channels)) ** 0.5, (SPAN * channels, FILTERS)),
            "conv0": np.zeros(FILTERS),
            "hide": rng.normal(0, (1 / FILTERS) ** 0.5, (2 * FILTERS, HIDDEN)),
            "hide0": np.zeros(HIDDEN),
            "out": rng.normal(0, 0.3, HIDDEN),
            "out0": np.zeros(1),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, codes: np.ndarray) -> tuple:
        p, (ids, mark) = self.p, (codes[:, 0], codes[:, 1])
        x = np.concatenate([p["embed"][ids], mark[:, :, None].astype(np.float32)], 2)
        cols = np.lib.stride_tricks.sliding_window_view(x, SPAN, 1).transpose(0, 1, 3, 2).reshape(len(codes), WIDTH - SPAN + 1, -1)
        z = np.maximum(cols @ p["conv"] + p["conv0"], 0)
        inside = z * mark[:, SPAN // 2 : SPAN // 2 + z.shape[1], None].astype(np.float32)
        at_all, at_in = z.argmax(1), inside.argmax(1)
        pooled = np.concatenate([np.take_along_axis(z, at_all[:, None], 1)[:, 0], np.take_along_axis(inside, at_in[:, None], 1)[:, 0]], 1)
        hidden = np.maximum(pooled @ p["hide"] + p["hide0"], 0)
        return hidden @ p["out"] + p["out0"], (cols, z, at_all, at_in, pooled, hidden, ids)

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.006, seed: int = 11) -> None:
        """Adam on the logistic loss."""
        rng, p = np.random.default_rng(seed), self.p
        m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(codes)), max(1, len(codes) // batch)):
                logit, (cols, z, at_all, at_in, pooled, hidden, ids) = self.forward(codes[at])
                d = ((1 / (1 + np.exp(-logit)) - labels[at]) / len(at)).astype(np.float32)
                g = {"out": hidden.T @ d, "out0": d.sum(keepdims=True)}
                dh = np.outer(d, p["out"]) * (hidden > 0)
                g |= {"hide": pooled.T @ dh, "hide0": dh.sum(0)}
                dp = (dh @ p["hide"].T) * (pooled > 0)
                dz = np.zeros_like(z)
                for where, part in ((at_all, dp[:, :FILTERS]), (at_in, dp[:, FILTERS:])):
                    np.put_along_axis(dz, where[:, None], np.take_along_axis(dz, where[:, None], 1) + part[:, None], 1)
                flat = dz.reshape(-1, FILTERS)
                g |= {"conv": cols.reshape(len(flat), -1).T @ flat, "conv0": flat.sum(0)}
                dcols = (flat @ p["conv"].T).reshape(len(at), -1, SPAN, EMBEDDED + 1)
                dx = np.zeros((len(at), WIDTH, EMBEDDED), np.float32)
                for k in range(SPAN):
                    dx[:, k : k + dcols.shape[1]] += dcols[:, :, k, :EMBEDDED]
                g["embed"] = np.eye(LETTERS, dtype=np.float32)[ids.ravel()].T @ dx.reshape(-1, EMBEDDED)
                t += 1
                for k in p:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, least_recall: float) -> None:
        """Fit a logistic curve to held-out scores; the threshold is the highest with the recall asked for."""
        logit = self.forward(codes)[0]
        a, b = 1.0, 0.0
        for _ in range(200):
            q = 1 / (1 + np.exp(-(a * logit + b)))
            a, b = a - 0.5 * np.mean((q - labels) * logit) / max(1.0, np.mean(logit**2)) * 4, b - 0.5 * np.mean(q - labels)
        self.scale, self.shift = a, b
        found = np.sort(self.score(codes)[labels == 1])
        self.threshold = float(found[int((1 - least_recall) * len(found))])

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, in blocks of bounded size."""
        parts = [self.forward(codes[k : k + 256])[0] for k in range(0, len(codes), 256)]
        logit = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -50, 50)))


def labelled_findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """``(text, start, end)`` of candidates in context, and whether each is a secret."""
    rng = random.Random(seed)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda letters, a, b: "".join(rng.choices(letters, k=rng.randint(a, b)))
    syllables = "th er on an re ti es or ou ing ion é ch en la de ein sch keit lich ung ver ment tion elle aux ble ado ci mar tro str ack ight ord um ex pro con sub schaft fahrt haupt ness ful able ive ate ity ous ism ual ract ject".split()
    onset = "b c d f g h j k l m n p r s t v w z y x st tr pl ch sh qu sch pf str spr thr cl br dr gr pr fr fl sp sk".split()
    vowel, coda = "a e i o u ea ou ie ai eu oo".split(), ["", "", "n", "r", "l", "s", "t", "nd", "st", "ck", "ft", "cht", "mpf", "ct", "ry", "ss", "ngs", "rt", "ff", "x", "ble"]
    syllable = lambda: rng.choice(syllables) if rng.random() < 0.5 else rng.choice(onset) + rng.choice(vowel) + rng.choice(coda)
    word = lambda k=4: "".join(syllable() for _ in range(rng.randint(1, k)))
    words = lambda k: [w.upper() if shout else w for shout in [rng.random() < 0.15] for w in (word() for _ in range(k))]
    joined = lambda by, a, b: by.join(word(3) for _ in range(rng.randint(a, b)))
    url_letters = low + up + digits + "-_"

    def secret() -> str:
        kind = rng.randrange(14)
        if kind < 3:
            return some("0123456789abcdef" if kind < 2 else "0123456789ABCDEF", 20, 64)
        if kind < 5:
            return some(low + up + digits, 18, 64)
        if kind == 5:
            return some(low + up + digits + "+/", 20, 90) + rng.choice(["", "=", "=="])
        if kind < 8:  # a name of the issuer before the key
            by = rng.choice("-_")
            issuer = by.join(some(low if rng.random() < 0.8 else up, 2, 6) for _ in range(rng.randint(1, 3))) + rng.choice([by, by, "."])
            return issuer + some(rng.choice([low + up + digits, low + up + digits, low + up, low + digits, url_letters, "0123456789abcdef"]), 18, 48)
        if kind == 8:
            return some(low + digits, 24, 40)
        if kind == 9:
            return some(low + up, 20, 48)
        if kind == 10:
            return some(url_letters, 22, 64)
        if kind == 11:
            return ".".join(["eyJ" * (rng.random() < 0.5) + some(url_letters, 12, 40), some(url_letters, 14, 60), some(url_letters, 20, 43)][: rng.randint(2, 3)])
        if kind == 12:
            return some(up + "234567", 20, 52)
        return rng.choice(["AKIA", "", ""]) + some(up + digits, 20, 32)

    def plain() -> str:
        kind = rng.randrange(26)
        if kind >= 20 and kind != 24:  # long words
            return rng.choice([str, str, str.title, str.upper])("".join(word(2) for _ in range(rng.randint(4, 9)))) + rng.choice(["", "", ".", "/", "="])
        if kind == 19:
            return rng.choice([str, str.upper])(joined(rng.choice(["-", "_", ".", "/", "=", "+", "--", "..."]), 3, 6)) + rng.choice(["", ".", ".html", ".py", "/"])
        if kind in (18, 24):
            return "".join(word(3).title() for _ in range(rng.randint(3, 6))) + rng.choice(["", "", "s", "Id", "Url", some(digits, 1, 3)])
        if kind == 17:
            return (some(low, 1, 4) * 20)[: rng.randint(16, 40)]
        if kind == 16:
            return rng.choice(["www.", "", "mail."]) + joined(".", 2, 3) + rng.choice([".com", ".org", ".example.net", ".de"]) + rng.choice(["", "/", "/" + joined("/", 1, 3), "/" + joined("-", 3, 5)])
        if kind == 15:
            return rng.choice(["DE", "ES", "FR", "GB", "AT", "BE"]) + some(digits, 14, 22)
        if kind == 14:
            return "-".join([joined("-", 1, 3), ".".join(some(digits, 1, 3) for _ in range(3)), word() + some(digits, 1, 2) + rng.choice([".deb", ".tar.gz", ".whl"])])
        if kind == 13:
            return "".join(rng.choice([some(digits, 1, 9), word(), rng.choice("+-/=.")]) for _ in range(8))[:48] if rng.random() < 0.3 else some(digits, 6, 9) + "." + some(digits, 8, 16)
        if kind >= 10:
            host = ".".join([rng.choice(["mail", "www", "cdn", "node", "m"]) + some(digits, 0, 2), word() + some(digits, 0, 2), rng.choice(["example", word()]), rng.choice(["com", "org", "net", "io", "co.uk"])])
            return rng.choice(["", word() + "." + word() + "."]) + host if kind > 10 else host + "/" + "/".join([word(), some(digits, 1, 5)])
        if kind < 3:
            return some(digits, 16, 20)
        if kind == 3:
            return rng.choice("-_").join([*(word() for _ in range(rng.randint(3, 5))), some(digits, 1, 4)])
        if kind == 4:
            return "/".join([word(), word(), some(digits, 4, 4), word() + ".html", word()])
        if kind == 5:
            return f"{word().title()}{word().title()}{word().title()}Handler{some(digits, 1, 2)}"
        if kind == 6:
            return f"IMG_20{some(digits, 6, 6)}_{some(digits, 6, 6)}"
        if kind == 7:
            return f"20{some(digits, 2, 2)}-{some(digits, 2, 2)}-{some(digits, 2, 2)}T{some(digits, 2, 2)}.{some(digits, 2, 2)}.{some(digits, 2, 2)}"
        if kind == 8:
            return rng.choice("-=._1x") * rng.randint(16, 40) + rng.choice(["", rng.choice(digits)])
        return ("".join(word() for _ in range(6)) + some(digits, 1, 3))[:40]

    findings, labels = [], []
    while len(findings) < n:
        good = rng.random() < 0.5
        value = secret() if good else plain()
        if not re.fullmatch("[A-Za-z0-9+/_.=-]{16,}", value):
            continue
        quote = rng.choice(['"', "'", "", ""])
        left = " ".join(words(rng.randint(0, 6)))
        name = rng.choice(["token", "key", "auth", "secret", "passphrase", "client", "bearer", "credential"]) if good else rng.choice(["page", "id", "see", "order", "card", "call", "item", "file"])
        if rng.random() < 0.6:
            left += " " + (name.upper() if left.isupper() else name) + rng.choice(["", "!!", "###", "***", "%%%"]) * (rng.random() < 0.3) + rng.choice([" = ", "=", ": ", " ", " is "])
        elif left:
            left += rng.choice([" ", "\n", ", ", " | "])
        right = rng.choice(["", "!!", "###", ".", ",", " |", "\n"]) + " " + " ".join(words(rng.randint(0, 4)))
        text = left + quote + value + quote + right
        at = len(left) + len(quote)
        findings.append((text, at, at + len(value)))
        labels.append(int(good))
    return findings, np.array(labels, np.float64)


def codes_of(findings: list[tuple[str, int, int]]) -> np.ndarray:
    return np.concatenate([windows(text, [(a, b)]) for text, a, b in findings])


@lru_cache(maxsize=1)
def trained(n: int = 8000, least_recall: float = 0.99) -> Network:
    """The network, trained on ``n`` labelled findings and calibrated on a third as many others."""
    net = Network()
    findings, labels = labelled_findings(n, seed=1)
    net.fit(codes_of(findings), labels)
    findings, labels = labelled_findings(n // 3, seed=2)
    net.calibrate(codes_of(findings), labels, least_recall)
    return net


def scores_of(text: str, spans: list[tuple[int, int]], net: Network) -> np.ndarray:
    """Scores of spans, read in blocks of bounded size."""
    return np.concatenate([net.score(windows(text, spans[k : k + 512])) for k in range(0, len(spans), 512)])


def find(text: str, net: Network) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by start: all findings of the rules, and what the network adds."""
    found = candidates(text)
    if not found:
        return []
    parts = [views(text, a, b) for _, _, a, b in found]
    firsts = np.cumsum([0, *map(len, parts[:-1])])
    scores = np.maximum.reduceat(scores_of(text, [v for some in parts for v in some], net), firsts)
    return [(kind, a, b, round(float(s), 4)) for (_, kind, a, b), s in zip(found, scores) if kind != "model" or s >= net.threshold]


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``doc_id, kinds, starts, ends, scores``: arrays with one entry per finding, positions in code points.

    Null and empty texts and texts without findings have empty arrays; whole texts are read, however
    long; repeated rows stay; ties by start go in the order of the kinds; other columns are not read.
    """

    def run(doc_ids, texts, net):
        found = [find(t, net) for t in texts]
        return {"doc_id": doc_ids} | {c: [[x[k] for x in one] for one in found] for k, c in enumerate(("kinds", "starts", "ends", "scores"))}

    schema = "doc_id long,kinds array<string>,starts array<int>,ends array<int>,scores array<double>"
    return map_batches(docs.select("doc_id", text_or_empty()), run, schema, net or trained())


def digests(scanned: DataFrame) -> DataFrame:
    """Counts and digests of what ``scan`` returns."""
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.struct(x["kinds"].alias("kind"), F.concat_ws(":", x["kinds"], x["starts"], x["ends"]).alias("span")))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda keep: F.array_join(F.transform(F.filter(spans, keep), lambda x: x["span"]), ",")
    return scanned.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(lambda x: x["kind"] != "model"), 256).alias("base_sha256"), joined(lambda x: F.lit(True)).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", net: Network | None = None) -> DataFrame:
    """The documents with each finding's span replaced by ``mark``; ``n_chars`` follows where there is one.

    Null texts stay null; texts without findings stay as they are; all other columns stay. Rows repeat as
    they do in ``docs``, whole texts are read, however long, and a table without rows gives none. Only
    changed texts come back from Python.
    """
    net = net or trained()

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(text):
            found = find(text, net) if text else []
            if not found:
                return None
            out, at = [], 0
            for _, a, b, _ in found:
                if b > at:
                    out += [text[at:a], mark] if a >= at else []
                    at = b
            return "".join([*out, text[at:]])

        return texts.map(one)

    done = docs.withColumn("text", F.coalesce(masked(F.col("text")), F.col("text")))
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
