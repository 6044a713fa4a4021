"""Full-text, vector and hybrid search over the given tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import cells as ce
from tidemark.operators import retrieval as rt
from tidemark.queries.browse import END, START, over
from tidemark.schema import DAY_MS
from tidemark.sources import tables as src

#: The queries' terms; one with a hyphen is a phrase. The last stands in raw texts only.
TERMS, PHRASE, RAW_ONLY = "that with", "of-the and", "Window-Help"
LOW, HIGH = START, START + 2 * DAY_MS
POOL, LIMIT = rt.candidate_pool(20), 20

F_, T_, X_ = src.frames, src.frame_text, src.vectors


def query_vector(vectors) -> list[float]:
    """The vector asked for: that of frame 0's first chunk."""
    return list(vectors.where("frame_id = 0 AND chunk_index = 0").first().embedding)


def stored(spark, sf_dir: str, column: str, stemmed: bool = False) -> rt.Index:
    """The index of a text layer, written once below the shared folder for the files as they are now."""
    texts = src.frame_text(spark, sf_dir)
    path = f"{src.shared_folder(spark)}/tidemark-index-3/{src.fingerprint(texts)}-{column}-{'stems' if stemmed else 'words'}"
    if "all" not in rt.segments(spark, path):
        rt.write_index(texts, column, path, stemmed)
    return rt.read_index(spark, path)


def corpus(spark, sf_dir: str, stemmed: bool = False, layers: tuple[str, ...] = ("content_text",)) -> rt.Corpus:
    return rt.Corpus(F_(spark, sf_dir), T_(spark, sf_dir), X_(spark, sf_dir), stemmed, {c: stored(spark, sf_dir, c, stemmed) for c in layers})


def arm(column, text, start=None, end=None, stemmed=False):
    def run(spark, sf_dir):
        window = (start, end) if start is not None else ()
        found = rt.text_arm(stored(spark, sf_dir, column, stemmed), F_(spark, sf_dir), text, POOL, *window, stemmed=stemmed)
        return found.select("frame_id", F.round("score", 6).alias("score"), "rank")

    return run


def near(**options):
    def run(frames, vectors):
        found = rt.knn(vectors, frames, query_vector(vectors), POOL, **options)
        return found.select("frame_id", F.round("distance", 6).alias("distance"), "rank")

    return over(F_, X_)(run)


def vector_cells(spark, vectors, name: str) -> ce.Cells:
    """The cell index of vectors, written once below the shared folder for the files as they are now."""
    path = f"{src.shared_folder(spark)}/tidemark-index-2/{src.fingerprint(vectors)}-{name}-cells"
    if "all" not in rt.segments(spark, path):
        ce.write_cells(vectors, path)
    return ce.read_cells(spark, path)


def near_by_cells(**options):
    def run(spark, sf_dir):
        vectors = X_(spark, sf_dir)
        found = vector_cells(spark, vectors, "text").knn(F_(spark, sf_dir), query_vector(vectors), POOL, **options)
        return found.select("frame_id", F.round("distance", 6).alias("distance"), "rank")

    return run


def asked_vectors(vectors):
    """Every ASKED_th frame's first vector is a query."""
    return vectors.where(f"frame_id % {ASKED} = 0 AND chunk_index = 0").select(F.col("frame_id").alias("query_id"), "embedding")


def batch_by_cells(spark, sf_dir):
    vectors = X_(spark, sf_dir)
    found = vector_cells(spark, vectors, "text").batch(asked_vectors(vectors), 10)
    return found.select("query_id", "frame_id", "chunk_index", F.round("distance", 6).alias("distance"))


def visits(spark, sf_dir):
    """What the searches of ``knn_cells_batch`` read and skip."""
    vectors = X_(spark, sf_dir)
    rows = rt.asked_for(asked_vectors(vectors), "query_id", "embedding")
    ids, queries = ce.np.array([r[0] for r in rows]), ce.np.array([r[1] for r in rows], float)
    return vector_cells(spark, vectors, "text").visits(ids, queries, 10)


def hybrid(text, include_chrome=False, **options):
    def run(spark, sf_dir):
        c = corpus(spark, sf_dir, layers=("content_text", "raw_text") if include_chrome else ("content_text",))
        return rt.hybrid_ids(c, text, LIMIT, query_vector(c.vectors), include_chrome=include_chrome, **options).select("frame_id", F.round("score", 9).alias("score"))

    return run


def full(spark, sf_dir):
    c = corpus(spark, sf_dir, True, ("content_text", "raw_text"))
    return rt.hybrid_search(c, TERMS, LIMIT, query_vector(c.vectors), include_chrome=True)


def context(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return rt.rag_context(c, TERMS, 8, query_vector(c.vectors))


def batch(vectors):
    queries = vectors.where("frame_id % 25 = 0 AND chunk_index = 0").select(F.col("frame_id").alias("query_id"), "embedding")
    return rt.knn_batch(vectors, queries, 10).select("query_id", "frame_id", "chunk_index", F.round("distance", 6).alias("distance"))


#: Every ASKED_th frame with a vector is a search of the batch: for the first two words of its text, and its vector.
ASKED = 50


def searches(spark, sf_dir):
    c = corpus(spark, sf_dir)
    own = c.vectors.where(f"chunk_index = 0 AND frame_id % {ASKED} = 0").select(F.col("frame_id").alias("query"), "embedding")
    words = F.array_join(F.slice(tx.tokens(F.col("content_text")), 1, 2), " ")
    text = c.texts.where(f"frame_id % {ASKED} = 0").select(F.col("frame_id").alias("query"), words.alias("text"))
    none = F.lit(None).cast("long")
    queries = own.join(text, "query", "left").select("query", F.coalesce("text", F.lit("")).alias("text"), "embedding", none.alias("start"), none.alias("end"))
    return rt.hybrid_batch(c, queries, LIMIT).select("query", "frame_id", F.round("score", 9).alias("score"), "rank")


def many_terms(spark, sf_dir):
    """Every ASKED_th frame is a search for the first two words of its text; the searches are read as they are dealt to passes."""
    words = F.slice(tx.tokens(F.col("content_text")), 1, 2)
    rows = T_(spark, sf_dir).where(f"frame_id % {ASKED} = 0").select("frame_id", words.alias("words")).orderBy("frame_id").toLocalIterator(prefetchPartitions=True)
    number = count()  # rows of one id are one search for the words of all
    terms = ((r.frame_id, next(number), 0, word) for r in rows for word in r.words)
    # Rounded as SQL does, by plain arithmetic: Spark's round takes longer on a row than all before it.
    return rt.bm25_batch(stored(spark, sf_dir, "content_text"), terms, spark).select("query", "frame_id", F.expr("-floor(-score * 1e6D + 0.5D) / 1e6D").alias("score"))


QUERIES = {
    "search_hybrid": full,
    "fts_bm25": arm("content_text", TERMS),
    "fts_phrase": arm("content_text", PHRASE),
    "fts_raw_layer": arm("raw_text", RAW_ONLY),
    "fts_time_window": arm("content_text", TERMS, LOW, HIGH),
    "fts_stemmed": arm("content_text", TERMS, stemmed=True),
    "fts_batch": many_terms,
    "knn_text": near(),
    "knn_in_range": near(start=LOW, end=HIGH),
    "knn_prefiltered": near(start=LOW, end=HIGH, prefilter=True),
    "knn_batch": over(X_)(batch),
    "knn_cells": near_by_cells(),
    "knn_cells_in_range": near_by_cells(start=LOW, end=HIGH),
    "knn_cells_prefiltered": near_by_cells(start=LOW, end=HIGH, prefilter=True),
    "knn_cells_batch": batch_by_cells,
    "knn_cells_visits": visits,
    "hybrid_rrf": hybrid(TERMS),
    "hybrid_rrf_time_window": hybrid(TERMS, start=LOW, end=HIGH),
    "hybrid_batch": searches,
    "hybrid_chrome": hybrid(RAW_ONLY, include_chrome=True),
    "rag_context": context,
    "fallback_snippet": over(T_)(lambda t: t.select("frame_id", tx.fallback_snippet(F.col("content_text")).alias("snippet"))),
    "normalize_text": over(T_)(lambda t: t.select("frame_id", tx.normalize_text(F.col("raw_text")).alias("text"))),
    "token_estimate": over(T_)(lambda t: t.select("frame_id", tx.token_estimate(F.col("content_text")).alias("tokens"))),
}


def layer_sql(name: str, column: str) -> str:
    words = f"regexp_extract_all(translate(lower({column}), '{tx.ACCENTED}', '{tx.PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"
    return f"{name} AS (SELECT frame_id, {words} AS w FROM frame_text)"


def score_sql(name: str, layer: str, text: str, stemmed: bool = False) -> str:
    """CTEs with ``frame_id, score`` of a query over a layer."""
    tfs = []
    for phrase in tx.query_phrases(text, stemmed):
        match = " AND ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(phrase))
        tfs.append(f"len(list_filter(generate_series(1, len(w)), lambda i: {match}))")
    cols = ", ".join(f"{x} AS t{k}" for k, x in enumerate(tfs))
    idf = lambda k: f"greatest(ln(((SELECT count(*) FROM {layer}) - (SELECT count(*) FROM {name}_tf WHERE t{k} > 0) + 0.5::DOUBLE) / ((SELECT count(*) FROM {name}_tf WHERE t{k} > 0) + 0.5::DOUBLE)), {rt.LEAST_IDF})"
    total = " + ".join(f"{idf(k)} * (t{k} * {rt.K1 + 1}::DOUBLE) / (t{k} + {rt.K1}::DOUBLE * (1 - {rt.B}::DOUBLE + {rt.B}::DOUBLE * size / (SELECT avg(len(w)) FROM {layer})))" for k in range(len(tfs)))
    return f"{name}_tf AS (SELECT frame_id, len(w) AS size, {cols} FROM {layer}), {name} AS (SELECT frame_id, -({total}) AS score FROM {name}_tf WHERE {' AND '.join(f't{k} > 0' for k in range(len(tfs)))})"


def arm_sql(name: str, scores: str, start: int | None = None, end: int | None = None) -> str:
    window = f" WHERE captured_at >= {start} AND captured_at < {end}" if start is not None else ""
    return f"{name} AS (SELECT *, row_number() OVER (ORDER BY score, frame_id) AS rank FROM (SELECT frame_id, score FROM {scores} WHERE frame_id IN (SELECT frame_id FROM frames{window}) ORDER BY score, frame_id LIMIT {POOL}))"


def knn_sql(name: str, start: int | None = None, end: int | None = None, prefilter: bool = False, frame: int = 0) -> str:
    inside = f"frame_id IN (SELECT frame_id FROM frames{f' WHERE captured_at >= {start} AND captured_at < {end}' if start is not None else ''})"
    near = f"SELECT frame_id, 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM vectors WHERE frame_id = {frame} AND chunk_index = 0)) AS distance, chunk_index FROM vectors{f' WHERE {inside}' if prefilter else ''} ORDER BY distance, frame_id, chunk_index LIMIT {POOL}"
    return f"{name} AS (SELECT *, row_number() OVER (ORDER BY distance, frame_id) AS rank FROM (SELECT frame_id, min(distance) AS distance FROM ({near}) WHERE {inside} GROUP BY frame_id))"


WITH = f"WITH {src.WITH}, {layer_sql('content', 'content_text')}, {layer_sql('raw', 'raw_text')}"
ARM = "SELECT frame_id, round(score, 6) AS score, rank FROM arm"
NEAR = "SELECT frame_id, round(distance, 6) AS distance, rank FROM near"


def fused_sql(*arms: str) -> str:
    ids = " UNION ".join(f"SELECT frame_id FROM {a}" for a in arms)
    total = " + ".join(["0.0::DOUBLE", *(f"coalesce(1.0::DOUBLE / (60 + (SELECT rank FROM {a} WHERE {a}.frame_id = ids.frame_id)), 0.0::DOUBLE)" for a in arms)])
    return f"SELECT frame_id, round(score, 9) AS score FROM (SELECT frame_id, {total} AS score FROM ({ids}) AS ids) ORDER BY score DESC, frame_id DESC LIMIT {LIMIT}"


def batch_sql() -> str:
    """The text arm of the batch alone, whose searches don't need a vector."""
    return hybrid_batch_sql("SELECT query, frame_id, round(score, 6) AS score FROM scored").replace("FROM vectors v LEFT JOIN content ON content.frame_id = v.frame_id WHERE v.chunk_index = 0 AND v.frame_id", "FROM content v WHERE v.frame_id").replace("v.embedding, ", "")


def hybrid_batch_sql(only: str = "") -> str:
    """All searches of the batch at once: per query, term and frame, then the same ranks and sums."""
    asked = f"asked AS (SELECT v.frame_id AS query, v.embedding, coalesce(list_slice(w, 1, 2), []) AS terms FROM vectors v LEFT JOIN content ON content.frame_id = v.frame_id WHERE v.chunk_index = 0 AND v.frame_id % {ASKED} = 0)"
    layer = "layer AS (SELECT count(*) AS total, avg(len(w)) AS mean FROM content)"
    words = "words AS (SELECT query, k, terms[k] AS term FROM (SELECT query, terms, unnest(generate_series(1, len(terms))) AS k FROM asked))"
    tf = "tf AS (SELECT frame_id, size, term, count(*) AS tf FROM (SELECT frame_id, len(w) AS size, unnest(w) AS term FROM content) WHERE term IN (SELECT term FROM words) GROUP BY ALL)"
    n_p = "n_p AS (SELECT term, count(*) AS n FROM tf GROUP BY term)"
    part = f"greatest(ln((total - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), {rt.LEAST_IDF}) * (tf * {rt.K1 + 1}::DOUBLE) / (tf + {rt.K1}::DOUBLE * (1 - {rt.B}::DOUBLE + {rt.B}::DOUBLE * size / mean))"
    scored = f"scored AS (SELECT query, frame_id, -sum({part}) AS score FROM words JOIN tf USING (term) JOIN n_p USING (term), layer GROUP BY query, frame_id HAVING count(*) = (SELECT count(*) FROM words w2 WHERE w2.query = words.query))"
    arm = f"arm AS (SELECT query, frame_id, row_number() OVER (PARTITION BY query ORDER BY score, frame_id) AS r FROM scored WHERE frame_id IN (SELECT frame_id FROM frames) QUALIFY r <= {POOL})"
    chunks = f"chunks AS (SELECT query, v.frame_id, 1 - list_cosine_similarity(v.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS distance FROM asked a, vectors v WHERE len(terms) > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, v.frame_id, v.chunk_index) <= {POOL})"
    near = f"near AS (SELECT query, frame_id, row_number() OVER (PARTITION BY query ORDER BY distance, frame_id) AS r FROM (SELECT query, frame_id, min(distance) AS distance FROM chunks WHERE frame_id IN (SELECT frame_id FROM frames) GROUP BY ALL) QUALIFY r <= {POOL})"
    fused = f"fused AS (SELECT query, frame_id, 0.0::DOUBLE + coalesce(1.0::DOUBLE / ({rt.RRF_K} + arm.r), 0) + coalesce(1.0::DOUBLE / ({rt.RRF_K} + near.r), 0) AS score FROM arm FULL JOIN near USING (query, frame_id))"
    if only:
        return f"{WITH}, {asked}, {layer}, {words}, {tf}, {n_p}, {scored} {only}"
    return f"{WITH}, {asked}, {layer}, {words}, {tf}, {n_p}, {scored}, {arm}, {chunks}, {near}, {fused} SELECT query, frame_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, frame_id DESC) AS rank FROM fused QUALIFY rank <= {LIMIT}"


def stems_sql() -> str:
    """CTE ``stems`` with ``word, stem`` of every distinct word of both layers: Porter's steps, one CTE each.

    A y that is a consonant is written Y on the way, so vowels and consonants are classes of letters, and the
    measure of a beginning counts its runs of vowels before consonants.
    """
    m = lambda x: f"len(regexp_extract_all({x}, '[aeiouy]+[^aeiouy]+'))"
    vowel = lambda x: f"regexp_matches({x}, '[aeiouy]')"
    short = lambda x: f"regexp_matches({x}, '[^aeiouy][aeiouy][^aeiouywxY]$')"
    cut = lambda n: f"left(w, length(w) - {n})"
    ends = lambda end: f"suffix(w, '{end}')"
    swaps = lambda table: "CASE " + " ".join(f"WHEN {ends(e)} THEN CASE WHEN {m(cut(len(e)))} > 0 THEN {cut(len(e))} || '{new}' ELSE w END" for e, new in table) + " ELSE w END"

    def dropped(end: str) -> str:
        part = cut(len(end) - (end in ("sion", "tion")))
        return f"WHEN {ends(end)} THEN CASE WHEN {m(part)} > 1 THEN {part} ELSE w END"

    twice = "length(w) > 1 AND lower(right(w, 1)) = lower(left(right(w, 2), 1)) AND NOT " + vowel("right(w, 1)") + " AND right(w, 1) NOT IN ('l', 's', 'z')"
    steps = [
        f"CASE WHEN {ends('sses')} OR {ends('ies')} THEN {cut(2)} WHEN {ends('s')} AND NOT {ends('ss')} THEN {cut(1)} ELSE w END",
        f"CASE WHEN {ends('eed')} THEN CASE WHEN {m(cut(3))} > 0 THEN {cut(1)} ELSE w END WHEN {ends('ed')} AND {vowel(cut(2))} THEN {cut(2)} || '-' WHEN {ends('ing')} AND {vowel(cut(3))} THEN {cut(3)} || '-' ELSE w END",
        f"CASE WHEN NOT was THEN w WHEN {ends('at')} OR {ends('bl')} OR {ends('iz')} THEN w || 'e' WHEN {twice} THEN {cut(1)} WHEN {m('w')} = 1 AND {short('w')} THEN w || 'e' ELSE w END",
        f"CASE WHEN lower(right(w, 1)) = 'y' AND {vowel(cut(1))} THEN {cut(1)} || 'i' ELSE w END",
        swaps(tx.TABLE_2),
        swaps(tx.TABLE_3),
        f"CASE {' '.join(map(dropped, tx.ENDS_4))} ELSE w END",
        f"CASE WHEN {ends('e')} AND ({m(cut(1))} > 1 OR ({m(cut(1))} = 1 AND NOT {short(cut(1))})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN {ends('ll')} AND {m('w')} > 1 THEN {cut(1)} ELSE w END",
    ]
    first = "porter0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM words WHERE regexp_full_match(word, '[a-z]{3,}'))"
    # What step 1b has cut carries a dash to the next step.
    of = lambda k: f"(SELECT word, rtrim(w, '-') AS w, {ends('-')} AS was FROM porter{k})" if k == 2 else f"porter{k}"
    chain = [f"porter{k + 1} AS (SELECT word, {step} AS w FROM {of(k)})" for k, step in enumerate(steps)]
    words = "words AS (SELECT DISTINCT word FROM (SELECT unnest(w) AS word FROM content UNION ALL SELECT unnest(w) FROM raw))"
    return ", ".join([words, first, *chain, f"stems AS (SELECT words.word, coalesce(lower(p.w), words.word) AS stem FROM words LEFT JOIN porter{len(steps)} p ON p.word = words.word)"])


def stemmed_sql(name: str, layer: str) -> str:
    """CTE of a layer whose words are stems."""
    each = f"SELECT frame_id, i, w[i] AS word FROM (SELECT frame_id, w, unnest(generate_series(1, len(w))) AS i FROM {layer})"
    return f"{name} AS (SELECT {layer}.frame_id, coalesce(x.w, []) AS w FROM {layer} LEFT JOIN (SELECT frame_id, list(stem ORDER BY i) AS w FROM ({each}) JOIN stems USING (word) GROUP BY frame_id) x ON x.frame_id = {layer}.frame_id)"


def snippet_sql(name: str, column: str, layer: str, terms: str) -> str:
    """CTE ``frame_id, snippet`` of the hits whose text holds a term: twelve tokens with the most different terms, the earliest of these."""
    token = "[\\p{L}\\p{N}]+"
    wanted = ", ".join(f"'{p[0]}'" for p in tx.query_phrases(terms, True))
    parts = f"SELECT frame_id, generate_subscripts(toks, 1) - 1 AS i, unnest(toks) AS tok, unnest(gaps[1:len(toks)]) AS gap, unnest(w) AS stem, len(toks) AS n FROM (SELECT frame_id, regexp_extract_all({column}, '{token}') AS toks, regexp_split_to_array({column}, '{token}') AS gaps, w FROM fused JOIN frame_text USING (frame_id) JOIN {layer} USING (frame_id))"
    window = rt.tx.SNIPPET_TOKENS
    return f"""{name}_parts AS ({parts}),
{name}_hits AS (SELECT * FROM {name}_parts WHERE stem IN ({wanted})),
{name}_best AS (SELECT a.frame_id, a.i, count(DISTINCT b.stem) AS kinds, any_value(a.n) AS n FROM {name}_hits a JOIN {name}_hits b ON a.frame_id = b.frame_id AND b.i >= a.i AND b.i < a.i + {window} GROUP BY a.frame_id, a.i QUALIFY row_number() OVER (PARTITION BY a.frame_id ORDER BY kinds DESC, a.i) = 1),
{name}_window AS (SELECT frame_id, n, greatest(0, least(i, n - {window})) AS low, least(n, greatest(0, least(i, n - {window})) + {window}) AS high FROM {name}_best),
{name} AS (SELECT frame_id, CASE WHEN any_value(low) > 0 THEN '…' ELSE '' END || string_agg(CASE WHEN i > low THEN gap ELSE '' END || CASE WHEN stem IN ({wanted}) THEN '[' || tok || ']' ELSE tok END, '' ORDER BY i) || CASE WHEN any_value(high) < any_value(p.n) THEN '…' ELSE '' END AS snippet
  FROM {name}_parts p JOIN {name}_window USING (frame_id) WHERE i >= low AND i < high GROUP BY frame_id)"""


def hits_sql() -> str:
    """The flagship: three arms, fused, with each hit's frame and snippet."""
    arms = [score_sql("s", "content_stems", TERMS, True), arm_sql("arm", "s"), score_sql("s2", "raw_stems", TERMS, True), arm_sql("arm2", "s2"), knn_sql("near")]
    fused = f"fused AS ({fused_sql('arm', 'arm2', 'near').replace('round(score, 9) AS score', 'score')})"
    cuts = [snippet_sql("of_content", "content_text", "content_stems", TERMS), snippet_sql("of_raw", "raw_text", "raw_stems", TERMS)]
    said = "coalesce(of_content.snippet, of_raw.snippet, CASE WHEN length(content_text) > 160 THEN content_text[:160] || '…' ELSE content_text END, '')"
    return f"{STEMMED}, {', '.join([*arms, fused, *cuts])} SELECT frame_id, captured_at, {said} AS snippet, score::REAL AS score, image_path, app_hint FROM fused JOIN frames USING (frame_id) LEFT JOIN frame_text USING (frame_id) LEFT JOIN of_content USING (frame_id) LEFT JOIN of_raw USING (frame_id)"


def rag_sql() -> str:
    ids = fused_sql("arm", "near").replace("round(score, 9) AS score", "score").replace(f"LIMIT {LIMIT}", "LIMIT 8")
    return f"{WITH}, {score_sql('s', 'content', TERMS)}, {arm_sql('arm', 's').replace(f'LIMIT {POOL}', f'LIMIT {rt.candidate_pool(8)}')}, {knn_sql('near').replace(f'LIMIT {POOL}', f'LIMIT {rt.candidate_pool(8)}')} SELECT frame_id, coalesce(content_text, '') AS text, score::REAL AS score, captured_at FROM ({ids}) JOIN frames USING (frame_id) LEFT JOIN frame_text USING (frame_id)"


STEMMED = f"{WITH}, {stems_sql()}, {stemmed_sql('content_stems', 'content')}, {stemmed_sql('raw_stems', 'raw')}"

ORACLES = {
    "search_hybrid": hits_sql(),
    "fts_stemmed": f"{STEMMED}, {score_sql('s', 'content_stems', TERMS, True)}, {arm_sql('arm', 's')} {ARM}",
    "hybrid_batch": hybrid_batch_sql(),
    "rag_context": rag_sql(),
    "fts_bm25": f"{WITH}, {score_sql('s', 'content', TERMS)}, {arm_sql('arm', 's')} {ARM}",
    "fts_phrase": f"{WITH}, {score_sql('s', 'content', PHRASE)}, {arm_sql('arm', 's')} {ARM}",
    "fts_raw_layer": f"{WITH}, {score_sql('s', 'raw', RAW_ONLY)}, {arm_sql('arm', 's')} {ARM}",
    "fts_time_window": f"{WITH}, {score_sql('s', 'content', TERMS)}, {arm_sql('arm', 's', LOW, HIGH)} {ARM}",
    "fts_batch": batch_sql(),
    "knn_text": f"{WITH}, {knn_sql('near')} {NEAR}",
    "knn_in_range": f"{WITH}, {knn_sql('near', LOW, HIGH)} {NEAR}",
    "knn_prefiltered": f"{WITH}, {knn_sql('near', LOW, HIGH, True)} {NEAR}",
    "knn_batch": f"{WITH} SELECT query_id, frame_id, chunk_index, round(distance, 6) AS distance FROM (SELECT q.frame_id AS query_id, v.frame_id, v.chunk_index, 1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM vectors v, vectors q WHERE q.frame_id % 25 = 0 AND q.chunk_index = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, frame_id, chunk_index) <= 10",
    "hybrid_rrf": f"{WITH}, {score_sql('s', 'content', TERMS)}, {arm_sql('arm', 's')}, {knn_sql('near')} {fused_sql('arm', 'near')}",
    "hybrid_rrf_time_window": f"{WITH}, {score_sql('s', 'content', TERMS)}, {arm_sql('arm', 's', LOW, HIGH)}, {knn_sql('near', LOW, HIGH)} {fused_sql('arm', 'near')}",
    "hybrid_chrome": f"{WITH}, {score_sql('s', 'content', RAW_ONLY)}, {arm_sql('arm', 's')}, {score_sql('s2', 'raw', RAW_ONLY)}, {arm_sql('arm2', 's2')}, {knn_sql('near')} {fused_sql('arm', 'arm2', 'near')}",
    "fallback_snippet": f"{WITH} SELECT frame_id, CASE WHEN length(content_text) > 160 THEN content_text[:160] || '…' ELSE content_text END AS snippet FROM frame_text",
    "normalize_text": f"{WITH} SELECT frame_id, lower(trim(regexp_replace(raw_text, '[\\s\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))) AS text FROM frame_text",
    "token_estimate": f"{WITH} SELECT frame_id, strlen(content_text) // 2 + 1 AS tokens FROM frame_text",
}
ORACLES |= {
    "knn_cells": ORACLES["knn_text"],
    "knn_cells_in_range": ORACLES["knn_in_range"],
    "knn_cells_prefiltered": ORACLES["knn_prefiltered"],
    "knn_cells_batch": ORACLES["knn_batch"].replace("q.frame_id % 25 = 0", f"q.frame_id % {ASKED} = 0"),
}
