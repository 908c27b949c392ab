"""Queries of the numbered operators: the given tables mapped to them, and results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.guards import cut_lineage
from . import covertree, decontam, dialogue, jaccard, licenses, minhash, mixture, negatives, quality, secrets, shards, suffixes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def notes(docs: DataFrame) -> DataFrame:
    """``documents`` as notes of tracks: (hash, note)."""
    return docs.select(F.col("doc_id").alias("hash"), F.col("text").alias("note"))


# Every word of a document with A-Z lower-cased, as the contracts of the queries say.
ALNUM_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    rf"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram FROM w),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, chr(1) ORDER BY gram)) AS sig FROM grams GROUP BY doc_id),
reps AS (SELECT sig, min(doc_id) AS doc_id, any_value(n) AS n FROM sizes GROUP BY sig),
held AS (SELECT g.doc_id, g.gram, r.n FROM grams g JOIN reps r USING (doc_id)),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o
  FROM held a JOIN held b ON a.gram = b.gram AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * o >= 80 * (nx + ny - o)),
copies AS (SELECT r.doc_id AS x, s.doc_id AS y FROM sizes s JOIN reps r USING (sig) WHERE r.doc_id <> s.doc_id),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links UNION SELECT x, y FROM copies UNION SELECT y, x FROM copies),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM documents d JOIN reach r ON r.x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""
)
def op7_note_classes(spark, folder):
    found = jaccard.note_components(notes(table(spark, folder, "documents")), width=5, percent=80)
    return found.withColumnRenamed("hash", "doc_id")


@query(
    f"SELECT c.*, n_links FROM ({SQL['op7_note_classes']}) c JOIN (" + rf"""WITH w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
linked AS (SELECT x, count(*) AS k FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * o >= 80 * (s.n + t.n - o) GROUP BY x)
SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_links FROM documents d LEFT JOIN linked ON x = d.doc_id) USING (doc_id)"""
)
def op7_note_links(spark, folder):
    found = jaccard.note_classes(notes(table(spark, folder, "documents")), width=5, percent=80)
    return found.withColumnRenamed("hash", "doc_id")


@query()
def op10_passages(spark, folder):
    cut = suffixes.without_repeats(notes(table(spark, folder, "documents")), length=100)
    return cut.select(
        F.col("hash").alias("doc_id"), F.octet_length(F.coalesce("note", F.lit(""))).cast("long").alias("n_bytes"),
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["e"] - s["s"]), F.lit(0).cast("long")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '{ALNUM_SQL}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER_SQL}, '{ALNUM_SQL}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS win FROM i),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, pos, dw.size, item_id FROM (SELECT doc_id, size, pos, array_to_string(w[pos:pos + size - 1], ' ') AS win FROM dw) dw JOIN iw USING (size, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""
)
def op4_decontamination(spark, folder):
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("item"), "text")
    found = decontam.contaminated_notes(notes(table(spark, folder, "documents")), items, size=10)
    return found.select(
        F.col("hash").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op3_shards(spark, folder):
    tracks = table(spark, folder, "documents").select(F.col("doc_id").alias("hash"), F.col("text").alias("payload"))
    return shards.shard_tracks(tracks, shards=24).select(
        F.col("hash").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"),
    )


@query(
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
o AS (SELECT html, max(page_id) AS owner FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM p LEFT JOIN o USING (html)"""
)
def op5_archives(spark, folder):
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("page"), "url", "html")
    return warc.archive_pages(pages).select(
        F.expr("try_cast(record AS bigint)").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("refers").cast("long").alias("refers_to"),
    )


@query()
def op8_secrets(spark, folder):
    cached = table(spark, folder, "documents").select(F.col("doc_id").alias("hash"), F.col("text").alias("response_json"))
    found = secrets.found_secrets(cached)

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    return found.select(
        F.col("hash").alias("doc_id"), *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(listed(of(*secrets.BASE)), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
    )


@query()
def op2_licenses(spark, folder):
    notices = table(spark, folder, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("notice"))
    found = licenses.licensed_notices(notices).select("name", "found.*")
    starts = F.transform("base", lambda p: p["start"])

    def labels(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    both = F.concat("base", "matches")
    covered = F.size(F.array_distinct(F.flatten(F.transform(both, lambda p: F.sequence(p["start"], p["end"] - 1)))))
    return found.select(
        F.col("name").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(F.col("base")).alias("base_labels"), labels(both).alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"),
    )


def grades(spark: SparkSession, folder: str) -> DataFrame:
    """``labels`` as grades of notes: (hash, keep)."""
    return table(spark, folder, "labels").select(F.col("doc_id").alias("hash"), F.col("quality").alias("keep"))


@query()
def op1_quality(spark, folder):
    texts = notes(table(spark, folder, "documents"))
    forest = quality.train_quality(texts, grades(spark, folder), most=20_000)
    return quality.graded_notes(texts, forest).select(
        F.col("hash").alias("doc_id"), quality.held_out(F.col("hash")).alias("held_out"), "score", "predicted"
    )


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""
)
def op9_nearest(spark, folder):
    tracks = table(spark, folder, "embeddings").select(F.col("vec_id").alias("hash"), "embedding")
    found = covertree.top_tracks(tracks, tracks.where("hash % 20 = 0"), k=20, scale=64)
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("hash").alias("vec_id"), "score")


# Parameters of the mixture: a source's domain, and weights on domains and languages.
DOMAINS = {"web": range(5), "forum": range(5, 10), "books": range(10, 15), "news": range(15, 20)}
WEIGHTS = {("web",): 0.4, ("forum",): 0.2, ("books",): 0.2, ("news",): 0.2} | {
    (d, lang): w for d in DOMAINS for lang, w in (("en", 0.55), ("de", 0.15), ("fr", 0.15), ("es", 0.15))
}
LEVELS = ("domain", "lang", "source")


def domain_of(source):
    named = F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int)"), F.lit(-1))
    out = F.lit("other")
    for name, numbers in DOMAINS.items():
        out = F.when(named.isin(*numbers), F.lit(name)).otherwise(out)
    return out


@query()
def op6_mixture(spark, folder):
    tracks = table(spark, folder, "documents").select(
        F.col("doc_id").alias("hash"), F.col("text").alias("note"), domain_of("source").alias("domain"), "lang", "source"
    )
    return mixture.mixed(tracks, LEVELS, WEIGHTS, share=0.8, epochs=2, seed=17).select(
        F.col("hash").alias("doc_id"), *LEVELS, "tokens", "copies"
    )


@query(
    """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5"""
)
def op11_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    tracks = table(spark, folder, "embeddings").select(F.col("vec_id").alias("hash"), label.alias("genre"), "embedding")
    found = negatives.hard_negatives(tracks, tracks.where("hash % 100 = 0"), positives=5, negatives=5, low=80, scale=256)
    return found.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("negative").alias("negative_id"), "positive_score", "negative_score",
    )


@query(
    SQL["op7_note_classes"].replace("len(ws) < 5", "len(ws) < 4").replace("len(ws) - 3", "len(ws) - 2").replace("ws[i:i + 4]", "ws[i:i + 3]")
    .replace("min(r.y) AS component_id", "min(r.y) AS component_id, d.doc_id = min(r.y) AS kept")
)
def op12_near_copies(spark, folder):
    return minhash.near_copies(notes(table(spark, folder, "documents")), width=4, percent=80).withColumnRenamed("hash", "doc_id")


# The damage that the contract of op13 does to a turn, by the remainder of its checksum.
DROPPED, EMPTIED, CUT, REPEATED, REROLED = range(5)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with the faults of the contract; a null is one blank."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.crc32(name.cast("binary")) % 20
    times = F.when(fate == DROPPED, 0).when(fate == REPEATED, 2).otherwise(1)
    text = F.when(fate == EMPTIED, "").when(fate == CUT, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hurt = rows.select("conv_id", "turn", F.when(fate == REROLED, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))
    return hurt.where("times > 0").withColumn("copy", F.explode(F.expr("sequence(1, times)"))).drop("times", "copy")


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ord(ch)::BIGINT)),
    lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, (c & 1) * 3988292384)))"""


@query(
    rf"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_CRC}, 4294967295) % 20 AS fate FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM raw),
nr AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
fl AS (SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b, regexp_replace(text, '[ 	-
]', '', 'g') AS solid,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM nr),
ft AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM fl),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (b IS NOT NULL AND b || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM ft GROUP BY conv_id),
steps(p, c, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ins(p, q, w, x) AS (SELECT p, p, 0, '' FROM range(4) t(p) UNION ALL SELECT ins.p, s.q, w + 2, x || 'I' FROM ins JOIN steps s ON s.p = ins.q AND s.c IN ('u', 'a') WHERE w < 4),
ops(c, fault, p, q, w, x) AS (
  SELECT '', f, p, p, 3, 'D' FROM range(4) t(p), (VALUES ('blank'), ('duplicate'), ('truncated'), ('')) g(f)
  UNION ALL SELECT c, f, p, q, e, 'K' FROM steps, (VALUES ('truncated', 1), ('', 0)) g(f, e)
  UNION ALL SELECT '', f, p, q, 2 + e, 'R' FROM steps, (VALUES ('truncated', 1), ('', 0)) g(f, e) WHERE c IN ('u', 'a')),
moves AS (SELECT o.c, o.fault, ins.p, o.q, ins.w + o.w AS w, ins.x || o.x AS x FROM ins JOIN ops o ON o.p = ins.q),
dp(conv_id, i, p, w, x) AS (
  SELECT conv_id, 0::BIGINT, 0, 0, '' FROM counts
  UNION ALL
  SELECT conv_id, i, q, w, x FROM (
    SELECT d.conv_id, d.i + 1 AS i, m.q, d.w + m.w AS w, d.x || m.x AS x, row_number() OVER (PARTITION BY d.conv_id, m.q ORDER BY d.w + m.w, d.x || m.x) AS k
    FROM dp d JOIN ft ON ft.conv_id IS NOT DISTINCT FROM d.conv_id AND ft.i = d.i + 1 JOIN moves m ON m.fault = ft.fault AND m.p = d.p AND m.c IN ('', ft.c))
  WHERE k = 1),
best AS (SELECT d.conv_id, d.w + ins.w AS cost, d.x || ins.x AS audit FROM dp d JOIN counts ON counts.conv_id IS NOT DISTINCT FROM d.conv_id AND counts.n = d.i JOIN ins ON ins.p = d.p AND ins.q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY d.conv_id ORDER BY d.w + ins.w, d.x || ins.x) = 1),
edits AS (SELECT conv_id, j, audit[j] AS e, len(replace(audit[:j], 'I', '')) AS i FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS j FROM best)),
kept AS (SELECT e.conv_id, e.j, e.e, ft.role, ft.text, row_number() OVER w AS place, coalesce(first_value(e.e = 'K' AND ft.c = 's') OVER w, FALSE) AS s
  FROM edits e LEFT JOIN ft ON ft.conv_id IS NOT DISTINCT FROM e.conv_id AND ft.i = e.i AND e.e <> 'I' WHERE e.e <> 'D' WINDOW w AS (PARTITION BY e.conv_id ORDER BY e.j)),
said AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place + s::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS t FROM kept GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM o.conv_id"""
)
def op13_repairs(spark, folder):
    rows = table(spark, folder, "conversations")
    hurt = damaged(rows)
    plans = cut_lineage(dialogue.repair_plans(hurt))
    digests = dialogue.repaired_digests(hurt, plans).withColumnRenamed("conv_id", "_conv")
    both = plans.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv").withColumnRenamed("conv_id", "_conv")
    out = rows.select("conv_id").distinct().join(both, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
