"""The operators' registered queries: thin calls on whole tables that derive the
result columns from what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm import ann, bpe, centroids, chat, convrepair, decontam, langid, linededup, quality, sharding, simhash, tokencount, topk
from relweave.llm.common import read


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of near equal bytes."""
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents"), n_shards=40)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, with item, edits and place."""
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def quality_field(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.LineField:
    """The field fitted on labels of documents that aren't held out."""
    labels = read(spark, sf_dir, "labels").where(_remainder(3) != 1).select("doc_id", "quality")
    return quality.fit(docs, labels)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = read(spark, sf_dir, "documents")
    out = quality.score(docs, quality_field(spark, sf_dir, docs))
    return out.withColumn("held_out", F.coalesce(_remainder(3) == 1, F.lit(False)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by models of the documents that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_remainder(5) != 0).select("lang", "text"))
    held = docs.select("text", "doc_id")
    return langid.predict(held, model).withColumn("held_out", F.coalesce(_remainder(5) == 0, F.lit(False)))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    return bpe.token_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, formatted and read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                  "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.unionByName(extra)))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    return ann.nearest(read(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that a smaller document holds."""
    out = linededup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens."""
    return tokencount.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every vector whose id is divisible by 50."""
    return topk.top_products(read(spark, sf_dir, "embeddings"), k=5, every=50)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged, audited and repaired."""
    rows = convrepair.damage(read(spark, sf_dir, "conversations"))
    return convrepair.summaries(convrepair.repair(rows, gone_col="gone"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after five rounds from 40 first centroids."""
    return centroids.cluster(read(spark, sf_dir, "embeddings"))[0]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline, from documents to token ids."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_decontamination, op3_quality, op4_language_id, op5_bpe, op6_simhash,
                                    op7_chat_format, op8_nearest, op9_line_dedup, op10_token_counts, op11_top_products, op12_conversation_repair,
                                    op13_centroids, pipeline)}

def _cluster_sql(k: int = centroids.CENTROIDS, rounds: int = centroids.ROUNDS) -> str:
    """One pair of steps for each round; the last assigns only."""
    parts = [f"""q AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             f"c0 AS MATERIALIZED (SELECT list(v ORDER BY h, v) AS cs FROM (SELECT sha256('2:' || vec_id) AS h, v FROM q ORDER BY h, v LIMIT {k}) t)"]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, list_sort(list_transform(range(len(cs)), lambda i: {{'d': CAST(list_sum(list_transform(range(1, 65),
  lambda j: (v[j] - cs[i + 1][j]) * (v[j] - cs[i + 1][j]))) AS BIGINT), 'k': i}}))[1] AS near FROM q, c{r})""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT list(coalesce(m.v, c.cs[i.k + 1]) ORDER BY i.k) AS cs FROM c{r} c, unnest(range(len(c.cs))) AS i(k)
  LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v
    FROM (SELECT near.k AS k, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{r}, unnest(range(1, 65)) AS u(j) GROUP BY near.k, j) t GROUP BY k) m ON m.k = i.k)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(near.k AS INTEGER) AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(cs[near.k + 1], ',')) AS centroid_sha256 FROM a{rounds}, c{rounds}"""

# crc32 byte by byte, over its table of 256 remainders
_CRC = """xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"""

#: The repair as a recursion over rows: in each state the least (cost, audit) with its text.
_REPAIR_SQL = rf"""WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda n: list_reduce([CAST(n AS BIGINT)] || list_transform(range(8), lambda i: CAST(i AS BIGINT)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
d AS (SELECT *, {_CRC} % 20 AS kind FROM k, tbl),
x AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS u(c)),
o AS (SELECT *, row_number() OVER w AS i,
    lag(role) OVER w AS before FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault,
    before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM o),
n AS (SELECT conv_id, count(*) AS n FROM f GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', 'user:'), (1, 2, 'I', 'user:'), (3, 2, 'I', 'user:'),
    (2, 3, 'I', 'assistant:'), (0, 3, 'II', 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 'user:' || chr(10) || 'assistant:')) v(a, z, e, t)),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, ins.z AS s, {{'c': 2 * length(ins.e), 'a': ins.e, 't': ins.t}} AS v FROM n, ins WHERE ins.a = 0
  UNION ALL
  SELECT conv_id, i, s, min(v) FROM (
    SELECT q.conv_id, q.i, ins.z AS s, {{'c': q.c + 2 * length(ins.e), 'a': q.a || ins.e, 't': q.t || CASE WHEN q.t = '' OR ins.t = '' THEN '' ELSE chr(10) END || ins.t}} AS v
    FROM (SELECT p.conv_id, p.i + 1 AS i, m.z AS s, p.v.c + m.c + CASE WHEN m.e <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END AS c, p.v.a || m.e AS a,
            p.v.t || CASE m.e WHEN 'D' THEN '' ELSE CASE WHEN p.v.t = '' THEN '' ELSE chr(10) END
              || CASE m.e WHEN 'K' THEN f.role ELSE CASE m.z WHEN 3 THEN 'assistant' ELSE 'user' END END || ':' || f.text END AS t
          FROM dp p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
          JOIN (VALUES (0, 0, 'D', 3, ''), (1, 1, 'D', 3, ''), (2, 2, 'D', 3, ''), (3, 3, 'D', 3, ''), (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'),
            (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'), (0, 2, 'R', 2, ''), (1, 2, 'R', 2, ''), (3, 2, 'R', 2, ''), (2, 3, 'R', 2, '')) m(a, z, e, c, r)
            ON m.a = p.s AND (m.e = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (m.e = 'R' OR m.r = left(f.role, 1))))) q
    JOIN ins ON ins.a = q.s) w GROUP BY conv_id, i, s),
best AS (SELECT dp.conv_id, min(v) AS v FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i WHERE s IN (0, 3) GROUP BY dp.conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, CAST(coalesce(best.v.c, 0) AS BIGINT) AS cost, coalesce(best.v.a, '') AS audit, sha256(coalesce(best.v.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id"""

#: The queries that SQL can express; the others are held against brute-force
#: versions in tests/llm (64-bit hashes, fitted models, merges, edit distance).
ORACLE: dict[str, str] = {
    "op7_chat_format": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (SELECT *, regexp_matches(text, '<s>|</s>|\[INST |\[/INST\]') OR contains(role, ']') OR suffix(role, '*') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(7 + sum(14 + length(role) + length(text) + CASE WHEN escaped
         THEN 1 + length(regexp_replace(role || text, '[^\\<\[\]*]', '', 'g')) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id""",
    "op9_line_dedup": r"""WITH l AS (SELECT doc_id, u.o AS pos, u.x AS line,
    translate(regexp_replace(u.x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS u(x, o)),
own AS (SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT l.*, own.owner IS NOT NULL AND own.owner <> l.doc_id AS gone FROM l LEFT JOIN own ON own.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op11_top_products": """WITH w AS (SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda j: q.v[j] * c.v[j])), 0) AS BIGINT) AS score
  FROM w q JOIN w c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_conversation_repair": _REPAIR_SQL,
    "op13_centroids": _cluster_sql(),
}
