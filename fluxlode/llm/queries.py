"""The operators' queries over the corpus tables and, where SQL expresses them, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import digest_chats, format_chats
from .decontaminate import MASKS, contaminated
from .jaccard import jaccard_components
from .langid import identify_languages
from .line_dedup import dedup_lines
from .lm_score import score_documents
from .packing import pack
from .quality import Resampling
from .store import table
from .substring_dedup import dedup_substrings
from .topk import exact_topk


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1 = """
WITH l AS (SELECT doc_id, u.n, u.line FROM (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(text, chr(10)) END AS s FROM documents),
  LATERAL (SELECT unnest(s) AS line, unnest(range(len(s))) AS n) u),
t AS (SELECT doc_id, n, list_transform(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM l),
k AS (SELECT DISTINCT doc_id, n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [['.', array_to_string(w, ' ')]] WHEN len(w) < 8 THEN [['=', array_to_string(w, ' ')]]
  ELSE [['<', len(w)::VARCHAR, array_to_string(w[:3 + (len(w) - 2) // 2], ' ')], ['>', len(w)::VARCHAR, array_to_string(w[:3], ' '), array_to_string(w[4 + (len(w) - 2) // 2:], ' ')]] END) AS key FROM t),
r AS (SELECT key, min(doc_id) AS least FROM k GROUP BY key HAVING count(DISTINCT doc_id) >= CASE WHEN key[1] = '.' THEN 20 ELSE 5 END),
g AS (SELECT DISTINCT doc_id, n FROM k JOIN r USING (key) WHERE doc_id > least)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (SELECT l.doc_id, count(*) AS n_lines, count(g.n) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.n) FILTER (g.n IS NULL) AS kept
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.n = g.n GROUP BY l.doc_id) c ON d.doc_id = c.doc_id
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).selected()


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("own")


WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
c AS (SELECT doc_id, doc_id AS t FROM s UNION SELECT c.doc_id, p.b FROM c JOIN p ON c.t = p.a)
SELECT s.doc_id, CAST(any_value(len(s.s)) AS BIGINT) AS n_shingles, min(c.t) AS component_id FROM s JOIN c ON s.doc_id = c.doc_id GROUP BY s.doc_id
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _seeds_sql(name: str, key: str) -> str:
    seeds = ", ".join(f"['{n}', " + ", ".join(f"w[p + {i + 1}]" for i, bit in enumerate(mask) if bit == "1") + "]" for n, mask in enumerate(MASKS))
    return f"""{name}_w AS (SELECT {key}, list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM {name} WHERE text IS NOT NULL),
{name}_p AS (SELECT {key}, w, unnest(range(len(w) - {len(MASKS[0]) - 1})) AS p FROM {name}_w WHERE len(w) >= {len(MASKS[0])}),
{name}_s AS (SELECT {key}, w, p, unnest([{seeds}]) AS seed FROM {name}_p)"""


OP6 = f"""
WITH {_seeds_sql("documents", "doc_id")}, {_seeds_sql("benchmark", "item_id")},
h AS (SELECT d.doc_id, b.item_id, d.w, b.w AS v, d.p, b.p AS j, least(len(b.w), 20) AS need, least(b.p, d.p, 10) AS l, least(len(b.w) - b.p - 10, len(d.w) - d.p - 10, 10) AS r
  FROM documents_s d JOIN benchmark_s b ON d.seed = b.seed),
s AS (SELECT DISTINCT doc_id, item_id, need, l + 10 + r AS width, list_transform(range(l + 10 + r), lambda i: CASE WHEN w[p - l + i + 1] = v[j - l + i + 1] THEN 1 ELSE 0 END) AS same FROM h WHERE l + 10 + r >= need),
m AS (SELECT doc_id, item_id, need, list_max(list_transform(range(width - need + 1), lambda i: list_sum(same[i + 1:i + need]))) AS matched FROM s)
SELECT doc_id, item_id, CAST(max(matched) AS INTEGER) AS matched, CAST(max(need) AS INTEGER) AS compared FROM m WHERE matched >= ceil(need * 0.8) GROUP BY doc_id, item_id
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8 = f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 20], ' ') AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM w WHERE len(w) >= 20)),
l AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM p) WHERE r > 1),
g AS (SELECT DISTINCT doc_id, i + j AS n FROM l, range(20) t(j)),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS n FROM w),
k AS (SELECT e.doc_id, count(g.n) AS gone, string_agg(e.word, ' ' ORDER BY e.n) FILTER (g.n IS NULL) AS kept FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.n = g.n GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "SELECT -1L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(own))
    return digest_chats(format_chats(chats))


def _escaped(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for control in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ANS]", "[ROLE]", "[/ROLE]", "[/TURN]"):
        x = f"replace({x}, '{control}', '{control[0]}\\{control[1:]}')"
    return x


OP9 = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, t.turn, t.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  lag(coalesce(role, ''), 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS before,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM c),
f AS (SELECT *, CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 20 + length({_escaped("role")}) END + length({_escaped("text")}) AS chars,
  CASE role WHEN 'system' THEN n = 1 WHEN 'user' THEN n = 1 OR before IN ('system', 'assistant') WHEN 'assistant' THEN before = 'user' ELSE FALSE END AS fits FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars, bool_and(fits) AND max_by(role, n) = 'assistant' AS valid
FROM f GROUP BY conv_id
"""

def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_line_dedup": op1_line_dedup, "op4_langid": op4_langid, "op5_ngram_jaccard": op5_ngram_jaccard, "op6_decontaminate": op6_decontaminate, "op2_quality": op2_quality, "op3_topk": op3_topk, "op7_packing": op7_packing, "op8_substring_dedup": op8_substring_dedup, "op9_chat": op9_chat, "op10_lm_score": op10_lm_score}
ORACLES = {"op1_line_dedup": OP1, "op5_ngram_jaccard": OP5, "op6_decontaminate": OP6, "op3_topk": OP3, "op8_substring_dedup": OP8, "op9_chat": OP9}
