"""The registered query of each operator over its whole table, and the SQL of those that SQL can state."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from agentmeter.llm import (
    bpe,
    chat,
    codes,
    decontaminate,
    packing,
    quality,
    secrets,
    separators,
    simhash,
    spelling,
    topk,
    toxicity,
    warc,
)
from agentmeter.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.groups(table(spark, directory, "documents"))


def op2_quality(spark: SparkSession, directory: str) -> DataFrame:
    return quality.classify(table(spark, directory, "documents"), table(spark, directory, "labels"))


def op3_chat(spark: SparkSession, directory: str) -> DataFrame:
    return chat.collapse(table(spark, directory, "conversations"))


OP3_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY turn) AS said FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT said[1:k] AS said FROM (SELECT said, unnest(range(1, n_turns)) AS k FROM c)),
kept AS (
  SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS copies
  FROM c ANTI JOIN p USING (said) GROUP BY said
)
SELECT conv_id, CAST(floor(turn / 1024) AS BIGINT) AS segment, n_turns, copies, string_agg(
    '<|im_start|>' || replace(coalesce(role, 'unknown'), '<|im_', '<| im_') || chr(10)
    || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered
FROM kept JOIN t USING (conv_id) GROUP BY ALL
"""


def op4_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    found = decontaminate.scan(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS said
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))
), places AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS said
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows))
), hits AS (SELECT doc_id, k, n, item_id FROM places JOIN windows USING (n, said)),
words AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op5_warc(spark: SparkSession, directory: str) -> DataFrame:
    return warc.round_trip(table(spark, directory, "pages"))


OP5_SQL = """
WITH p AS (
  SELECT page_id, sha1(encode(coalesce(html, ''))) AS hex, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), k AS (SELECT hex, max(page_id) AS keeper FROM p GROUP BY hex),
bits AS (
  SELECT hex, array_to_string(list_transform(string_split(hex, ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101',
    '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM k
), b32 AS (
  SELECT hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, i * 5 + j, 1) AS INT) << (5 - j))) AS INT), 1)), '') AS digest
  FROM bits
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p JOIN k USING (hex) JOIN b32 USING (hex)
"""


def op6_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    return separators.counts(table(spark, directory, "documents"))


def op7_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, directory, "documents")))


def op8_topk(spark: SparkSession, directory: str) -> DataFrame:
    return topk.top(table(spark, directory, "embeddings"), nameless=True)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS number, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.number, r.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.number <> r.number AND len(q.v) = len(r.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.score(table(spark, directory, "documents"), table(spark, directory, "labels"))


def op10_secrets(spark: SparkSession, directory: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, directory, "documents")))


def op11_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return bpe.digests(bpe.decode(bpe.encode(table(spark, directory, "documents"))))


def op12_codes(spark: SparkSession, directory: str) -> DataFrame:
    coded, books = codes.encode(table(spark, directory, "embeddings"))
    return codes.with_label_errors(coded).withColumn("codebooks_sha256", F.sha2(F.lit(codes.stated(books)), 256))


def _op12_sql() -> str:
    """One round of assigning and averaging after the other, written out."""
    square = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = f"""SELECT p.rid, p.part, min(struct_pack(d := CAST({square} AS BIGINT), e := b.entry)) AS s
      FROM p JOIN {{book}} b USING (part) GROUP BY p.rid, p.part"""
    steps = [
        """v AS MATERIALIZED (
      SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid, len(v) // 8 AS w FROM v)",
        "p AS MATERIALIZED (SELECT rid, part, v[part * w + 1 : part * w + w] AS x FROM r, (SELECT unnest(range(8)) AS part))",
        "b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= 16)",
    ]
    for k in range(codes.ROUNDS):
        steps += [
            f"a{k} AS MATERIALIZED ({nearest.format(book=f'b{k}')})",
            f"""m{k} AS (SELECT part, s.e AS entry, place, sum(CAST(x[place] AS HUGEINT)) AS t, count(*) AS n
      FROM (SELECT part, s, x, unnest(range(1, len(x) + 1)) AS place FROM a{k} JOIN p USING (rid, part)) GROUP BY ALL)""",
            f"""b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(y, x) AS x FROM b{k} LEFT JOIN (
      SELECT part, entry, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY place) AS y FROM m{k} GROUP BY ALL
    ) USING (part, entry))""",
        ]
    last = f"b{codes.ROUNDS}"
    steps += [
        f"z AS MATERIALIZED ({nearest.format(book=last)})",
        """c AS (SELECT rid, string_agg(printf('%02x', CAST(s.e AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(s.d) AS BIGINT) AS error
      FROM z GROUP BY rid)""",
        f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM {last})",
    ]
    return (
        "WITH " + ",\n".join(steps) + """
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM r JOIN c USING (rid), h"""
    )


def op13_spelling(spark: SparkSession, directory: str) -> DataFrame:
    return spelling.variants(table(spark, directory, "documents"))


OP13_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc
), runs AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''),
      lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END))),
    lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]))) AS h
  FROM runs, crc
), words AS MATERIALIZED (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
    CAST(sum(k) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND n >= 3
), holes AS MATERIALIZED (
  SELECT word, n, substr(word, 1, k - 1) AS a, substr(word, k + 1) AS b FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM words)
), shorter AS (SELECT DISTINCT h.word AS long, h.n AS long_n, w.word AS short, w.n AS short_n FROM holes h JOIN words w ON w.word = h.a || h.b),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT long, short, short_n FROM shorter UNION ALL SELECT short, long, long_n FROM shorter
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS m, min(struct_pack(n := -other_n, w := other)).w AS other FROM near GROUP BY word
), formed AS MATERIALIZED (
  SELECT w.word, w.n, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n,
    coalesce(n_near, 0) AS n_near FROM words w LEFT JOIN best USING (word)
), chains AS (
  SELECT word, word AS at, form AS further FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN formed f ON f.word = c.further
)
SELECT f.*, c.at AS root FROM formed f JOIN chains c ON c.word = f.word AND c.further IS NULL
"""


def pipeline(spark: SparkSession, directory: str) -> DataFrame:
    return corpus_pipeline.run(spark, directory)


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_simhash,
            op2_quality,
            op3_chat,
            op4_decontamination,
            op5_warc,
            op6_token_counts,
            op7_packing,
            op8_topk,
            op9_toxicity,
            op10_secrets,
            op11_bpe,
            op12_codes,
            op13_spelling,
            pipeline,
        )
    }


def oracle_sql() -> dict[str, str]:
    stated = {
        "op3_chat": OP3_SQL,
        "op4_decontamination": OP4_SQL,
        "op5_warc": OP5_SQL,
        "op8_topk": OP8_SQL,
        "op12_codes": _op12_sql(),
        "op13_spelling": OP13_SQL,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: sql for name, sql in stated.items() if sql}
