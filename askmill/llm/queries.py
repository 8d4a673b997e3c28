"""The operators as queries over the test tables, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.llm import collisions, dom_crf, hilbert, imatch, licenses, mixing, nbsvm, packing, simhash, spelling, token_files, tool_calls, trie
from askmill.llm.frames import stored, table, zero_if_empty
from askmill.session import prepare

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprinted(table(prepare(spark), folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mixed(table(prepare(spark), folder, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_hilbert(spark: SparkSession, folder: str) -> DataFrame:
    rows = hilbert.sharded(table(prepare(spark), folder, "documents"))
    return rows.withColumn("grown_shard", F.lit(None).cast("int"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    cut = packing.pieces(table(prepare(spark), folder, "documents"), WORD_BPE)
    return packing.packed(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = token_files.written_and_read(table(prepare(spark), folder, "documents"), BYTE_BPE)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_duplicates(table(prepare(spark), folder, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op7_dom_crf(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(prepare(spark), folder, "pages")
    return dom_crf.extracted(pages, dom_crf.train(pages))


def op8_nbsvm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(prepare(spark), folder, "documents").select("doc_id", "text")
    rows = nbsvm.scored(docs, quality_model(spark, folder))
    return rows.select("doc_id", nbsvm.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def quality_model(spark: SparkSession, folder: str) -> tuple[bytes, float, float]:
    """Learnt from the labels that are not held out."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return nbsvm.train(table(spark, folder, "documents"), labels.where(~nbsvm.held_out(F.col("doc_id"))))


#: Tools of the conversations' calls: name, parameter, kind, whether it is required.
SCHEMAS = [
    ("search", "query", "string", True),
    ("search", "limit", "integer", True),
    ("search", "exact", "boolean", False),
    ("measure", "limit", "number", True),
    ("measure", "query", "string", False),
    ("measure", "exact", "boolean", False),
    ("route", "exact", "boolean", True),
    ("route", "query", "string", True),
    ("route", "limit", "integer", False),
]

# The conversations hold plain turns. Each assistant turn is taken as a call and any other turn as the result of
# the turn before it; lengths decide the parent, the tool, and which arguments are at fault. The whole text, but
# for what JSON would escape, is an argument. Both engines read this.
CALLS = """
SELECT conv_id, turn, concat('c', CAST(turn AS {text})) AS call_id,
  CASE WHEN length(text) % 4 <> 0 THEN concat('c', CAST(turn - 2 AS {text})) END AS parent_id,
  CASE WHEN length(text) % 19 = 0 THEN 'guess' WHEN turn % 3 = 0 THEN 'search' WHEN turn % 3 = 1 THEN 'measure' ELSE 'route' END AS name,
  concat('{{"limit":', CASE WHEN length(text) % 7 = 0 THEN concat('"', CAST(length(text) AS {text}), '"') ELSE CAST(length(text) AS {text}) END,
    CASE WHEN length(text) % 11 = 0 THEN '' ELSE concat(', "query" : "', regexp_replace(text, '[^A-Za-z0-9 ]', '_'{every}), '"') END,
    CASE WHEN length(text) % 17 = 0 THEN ',"page":1' ELSE '' END,
    ',"exact":', CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END,
    CASE WHEN length(text) % 13 = 0 THEN '' ELSE '}}' END) AS arguments
FROM {turns} WHERE role = 'assistant'
"""
RESULTS = """
SELECT conv_id, turn, concat('c', CAST(turn - 1 AS {text})) AS call_id, text AS content
FROM {turns} WHERE role IS DISTINCT FROM 'assistant'
"""


def op9_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    view = f"conversations_{uuid.uuid4().hex}"
    table(prepare(spark), folder, "conversations").createOrReplaceTempView(view)
    schemas = spark.createDataFrame(SCHEMAS, "name string, parameter string, kind string, required boolean")
    calls, results = (spark.sql(q.format(text="STRING", every="", turns=view)) for q in (CALLS, RESULTS))
    spark.catalog.dropTempView(view)
    return tool_calls.linked(calls, results, schemas)


def op10_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return collisions.near_duplicates(table(prepare(spark), folder, "embeddings"))


def grafted(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Placed turns and members, rebuilt: the first turns of each conversation come from the one that its five share."""
    convs = stored(trie.members(turns).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 9), "convs")
    base = F.col("conv_id") - F.col("conv_id") % 5
    given = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    led = convs.withColumn("base", base).join(given, "base", "left")
    led = stored(led.select("conv_id", "base", "h", F.least("h", zero_if_empty(F.col("base_n"))).alias("lead")), "leads")
    own = turns.join(led, "conv_id").where("pos >= h").withColumn("pos", F.col("lead") + F.col("pos") - F.col("h"))
    first = turns.where((F.col("conv_id") % 5 == 0) & (F.col("pos") < 8)).withColumnRenamed("conv_id", "base")
    columns = ["conv_id", "pos", "a", "b", "size"]
    rows = own.select(columns).unionByName(first.join(led, "base").where("pos < lead").select(columns))
    rows = stored(rows, "rebuilt")
    sums = led.select("conv_id").join(trie.members(rows), "conv_id", "left")
    return rows, stored(sums.na.fill(0, ["n", "size"]), "members")


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = stored(trie.placed(table(prepare(spark), folder, "conversations")), "placed")
    return trie.nodes(*grafted(turns))


#: Phrases whose places are counted, and their labels.
LICENSE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    rows = licenses.scanned(table(prepare(spark), folder, "documents").select("doc_id", "text"), LICENSE_PHRASES)
    labels = lambda *columns: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.col(f"{c}.label") for c in columns)))), ",")
    return rows.select(
        "doc.doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first").alias("first_word"),
        F.array_max("places.first").alias("last_word"),
        labels("places").alias("base_labels"),
        labels("places", "detections").alias("labels"),
        licenses.score("detections").alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    counted = spelling.counted(table(prepare(spark), folder, "documents"), slips=97)
    return spelling.grouped(counted)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (
        op1_imatch,
        op2_mixing,
        op3_hilbert,
        op4_packing,
        op5_token_files,
        op6_simhash,
        op7_dom_crf,
        op8_nbsvm,
        op9_tool_calls,
        op10_collisions,
        op11_prefix_trie,
        op12_licenses,
        op13_spelling,
        pipeline,
    )
}

_RULES = ", ".join(f"('{n}', '{p}', '{k}', {str(r).lower()})" for n, p, k, r in SCHEMAS)

# crc32 of a text: its bytes through the eight shifts of the polynomial.
_CRC32 = """xor(4294967295::BIGINT, list_reduce(
  [4294967295::BIGINT] || list_transform(range(0, strlen({0}), 1), lambda i: ('0x' || substr(hex(encode({0})), (2 * i + 1)::INT, 2))::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda a, i: xor(a >> 1, 3988292384::BIGINT * (a & 1)))))"""

ORACLE = {
    "op13_spelling": f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
each AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY 1, 2),
crcs AS (SELECT run, n, {_CRC32.format("named")} AS h FROM each),
slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM crcs),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cuts AS (SELECT word, n, substr(word, 1, i::INT) AS x, substr(word, i::INT + 2) AS y FROM words, range(0, 64) r(i) WHERE i < length(word)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.x = b.x AND a.y = b.y WHERE a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.x || c.y
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.x || c.y),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM pairs GROUP BY 1),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 2 * w.n THEN b.most END AS form_n,
    (SELECT min(p.near) FROM pairs p WHERE p.word = w.word AND p.near_n = b.most AND b.most >= 2 * w.n) AS form
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
""",
    "op11_prefix_trie": f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 9 AS h, count(*) AS n FROM turns GROUP BY conv_id),
led AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS lead FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
rebuilt AS (
  SELECT l.conv_id, t.pos + 1 AS depth, t.role, t.text FROM led l JOIN turns t ON t.conv_id = l.base AND t.pos < l.lead
  UNION ALL
  SELECT l.conv_id, t.pos - l.h + l.lead + 1, t.role, t.text FROM led l JOIN turns t ON t.conv_id = l.conv_id AND t.pos >= l.h),
paths AS (
  SELECT conv_id, depth, strlen(text) AS size,
    md5(string_agg(md5(role || chr(1) || text), ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS path FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs),
tops AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS top, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM paths),
firsts AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, path) AS first, bool_and(depth = top) OVER (PARTITION BY depth, path) AS childless FROM tops),
own AS (
  SELECT *, sum(CASE WHEN first <> conv_id THEN size ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY depth DESC) AS shared,
    CASE WHEN bool_or(childless AND depth = top AND first = conv_id) OVER (PARTITION BY conv_id) THEN 1 ELSE 0 END AS leaf FROM firsts),
grown AS (
  SELECT depth, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, sum(leaf) AS n_leaves, sum(shared) AS saved_tokens,
    sha256(coalesce(string_agg(CASE WHEN depth = top THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM own GROUP BY depth, path),
children AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n FROM grown WHERE depth > 0 GROUP BY 1, 2)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, coalesce(c.n, 0) AS n_children,
  CAST(g.n_leaves AS BIGINT) AS n_leaves, CAST(g.saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
FROM grown g LEFT JOIN grown p ON p.depth = g.depth - 1 AND p.path = g.above LEFT JOIN children c ON c.depth = g.depth AND c.path = g.path
""",
    "op9_tool_calls": f"""
WITH RECURSIVE calls AS ({CALLS.format(text="VARCHAR", every=", 'g'", turns="conversations")}),
results AS ({RESULTS.format(text="VARCHAR", turns="conversations")}),
rules(name, parameter, kind, required) AS (VALUES {_RULES}),
parsed AS (SELECT *, CASE WHEN json_valid(arguments) THEN CAST(arguments AS JSON) END AS js FROM calls),
members AS (SELECT p.conv_id, p.turn, p.name, m.key, m.type, m.value FROM parsed p, json_each(p.js) m WHERE p.js IS NOT NULL),
checked AS (
  SELECT m.conv_id, m.turn,
    sum(CASE WHEN r.required THEN 1 ELSE 0 END) AS given,
    sum(CASE WHEN r.kind IS NULL THEN 0
      WHEN r.kind = 'string' AND m.type = 'VARCHAR' THEN 0
      WHEN r.kind IN ('integer', 'number') AND m.type IN ('UBIGINT', 'BIGINT') THEN 0
      WHEN r.kind = 'number' AND m.type = 'DOUBLE' THEN 0
      WHEN r.kind = 'boolean' AND m.type = 'BOOLEAN' THEN 0 ELSE 1 END) AS wrong,
    sum(CASE WHEN r.kind IS NULL THEN 1 ELSE 0 END) AS unknown,
    string_agg(concat('"', m.key, '":', CAST(m.value AS VARCHAR)), ',' ORDER BY m.key) AS inside
  FROM members m LEFT JOIN rules r ON r.name = m.name AND r.parameter = m.key GROUP BY 1, 2),
chain AS (
  SELECT c.conv_id, c.call_id, 0 AS depth FROM calls c
  LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.call_id = c.parent_id WHERE p.call_id IS NULL
  UNION ALL
  SELECT c.conv_id, c.call_id, chain.depth + 1 FROM calls c
  JOIN chain ON chain.conv_id = c.conv_id AND chain.call_id = c.parent_id),
needs AS (SELECT name, sum(CASE WHEN required THEN 1 ELSE 0 END) AS needed FROM rules GROUP BY 1),
judged AS (
  SELECT c.*, chain.depth, k.inside,
    CASE WHEN n.needed IS NULL THEN 'unknown_tool' WHEN c.js IS NULL THEN 'malformed'
      WHEN coalesce(k.given, 0) < n.needed THEN 'missing' WHEN k.wrong > 0 THEN 'wrong_type'
      WHEN k.unknown > 0 THEN 'unknown_argument' ELSE 'ok' END AS status,
    (SELECT count(*) FROM results r WHERE r.conv_id = c.conv_id AND r.call_id = c.call_id) AS n_results
  FROM parsed c JOIN chain ON chain.conv_id = c.conv_id AND chain.call_id = c.call_id
  LEFT JOIN checked k ON k.conv_id = c.conv_id AND k.turn = c.turn LEFT JOIN needs n ON n.name = c.name),
rows_ AS (
  SELECT conv_id, turn, 'call' AS kind, call_id, name, status, CAST(depth AS BIGINT) AS depth, n_results,
    concat('{{"arguments":', CASE WHEN js IS NULL THEN 'null' ELSE concat('{{', inside, '}}') END, ',"id":', CAST(to_json(call_id) AS VARCHAR),
      ',"name":', CAST(to_json(name) AS VARCHAR), ',"role":"assistant","status":', CAST(to_json(status) AS VARCHAR), '}}') AS message,
    CAST(depth * 2 AS BIGINT) AS rank_
  FROM judged
  UNION ALL
  SELECT r.conv_id, r.turn, 'result', r.call_id, j.name, CASE WHEN j.call_id IS NULL THEN 'orphan' ELSE 'linked' END,
    CAST(j.depth AS BIGINT), 0,
    concat('{{"content":', coalesce(CAST(to_json(r.content) AS VARCHAR), 'null'), ',"name":', coalesce(CAST(to_json(j.name) AS VARCHAR), 'null'),
      ',"role":"tool","tool_call_id":', CAST(to_json(r.call_id) AS VARCHAR), '}}'),
    coalesce(CAST(j.depth * 2 + 1 AS BIGINT), 1099511627777)
  FROM results r LEFT JOIN judged j ON j.conv_id = r.conv_id AND j.call_id = r.call_id)
SELECT conv_id, turn, kind, call_id, name, status, depth, n_results, message,
  row_number() OVER (PARTITION BY conv_id ORDER BY rank_, turn, call_id, kind, message) - 1 AS position
FROM rows_
""",
}
