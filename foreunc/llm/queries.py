"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreunc.llm import bpe, contamination, html, lines, lm, neardup, planes, quality, spelling, topk, toxicity, trie, urls
from foreunc.llm.common import shared_folder

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_byte_bpe(spark, sf):
    """Encode all texts, decode the ids, digest both."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.decode_documents(bpe.encode_documents(table(spark, sf, "documents"), path), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_top_k(spark, sf):
    """Ten best rows for every hundredth vector."""
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


ORACLES["op4_top_k"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), ranked AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM whole q JOIN whole r ON q.vec_id <> r.vec_id
  WHERE q.vec_id % 100 = 0
), numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM ranked
)
SELECT query_id, rank, vec_id, score FROM numbered WHERE rank <= 10
"""


def remainder(modulus: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query
def op9_toxicity(spark, sf):
    """Score all documents, learning from four fifths of the labelled ones."""
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"), remainder(5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )


@query
def op10_id_planes(spark, sf):
    """Encode all texts, write the id files, and describe what reading them gives."""
    folder = shared_folder(spark, "ids")
    path = public_tokenizers.path("word_bpe_49k.json")
    planes.write_ids(table(spark, sf, "documents"), folder, path, end_id=2)
    return planes.read_ids(spark, folder)


@query
def op8_near_duplicates(spark, sf):
    """Classes of documents with similar sets of two-word shingles."""
    return neardup.near_duplicates(table(spark, sf, "documents"), words=2, similarity=80)


#: Shingle sets of {table} as (doc_id, s), s a list of distinct shingles.
SHINGLES_SQL = """
  SELECT doc_id, list_distinct(
    CASE WHEN len(w) = 0 THEN []
         WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words} - 1], ' '))
    END) AS s
  FROM (SELECT doc_id, regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\\x20\\x09-\\x0D]+') AS w
        FROM {table})
"""

ORACLES["op8_near_duplicates"] = (
    """
WITH RECURSIVE sets AS MATERIALIZED ("""
    + SHINGLES_SQL.format(table="documents", words=2)
    + """), items AS (SELECT doc_id, unnest(s) AS x FROM sets WHERE doc_id IS NOT NULL),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM common
  JOIN sets l ON l.doc_id = a JOIN sets r ON r.doc_id = b
  WHERE 100 * n >= 80 * (len(l.s) + len(r.s) - n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets WHERE doc_id IS NOT NULL
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), heads AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept
FROM sets LEFT JOIN heads ON heads.a = doc_id
"""
)


@query
def op5_decontamination(spark, sf):
    """Documents that hold a benchmark item."""
    return contamination.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


#: As SHINGLES_SQL, with lower() for all letters.
PLAIN_SHINGLES_SQL = """
  SELECT {id}, list_distinct(
    CASE WHEN len(w) = 0 THEN []
         WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words} - 1], ' '))
    END) AS s
  FROM (SELECT {id}, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM {table})
"""

ORACLES["op5_decontamination"] = (
    "WITH d AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(s) AS x FROM ("
    + PLAIN_SHINGLES_SQL.format(id="doc_id", words=5, table="documents")
    + ") WHERE doc_id IS NOT NULL)), b AS (SELECT DISTINCT item_id, x FROM (SELECT item_id, unnest(s) AS x FROM ("
    + PLAIN_SHINGLES_SQL.format(id="item_id", words=5, table="benchmark")
    + """) WHERE item_id IS NOT NULL)), n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item
FROM d JOIN b USING (x) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""
)


@query
def op6_line_dedup(spark, sf):
    """Class of every line, exact and fuzzy; one line of each is kept."""
    return lines.line_classes(table(spark, sf, "documents"))


#: Two lines of at least SHINGLE bytes can only be similar if they share one of their rarest shingles:
#: of n, all but 80 % may be missing, so floor(n / 5) + 1 of them in a fixed order must meet.
ORACLES["op6_line_dedup"] = """
WITH RECURSIVE lines AS MATERIALIZED (
  SELECT doc_id, CAST(line_no - 1 AS INTEGER) AS line_no, trim(lower(line), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
        FROM documents WHERE doc_id IS NOT NULL)
  WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
), nodes AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY min(doc_id * 10000000 + line_no)) AS node, min(doc_id * 10000000 + line_no) AS spot, body
  FROM lines GROUP BY body
), shingles AS MATERIALIZED (
  SELECT DISTINCT node, x FROM (
    SELECT node, unnest(list_transform(range(1, greatest(octet_length(encode(body)) - 7, 1) + 1),
                                       lambda i: substr(hex(encode(body)), 2 * i - 1, 16))) AS x FROM nodes)
), sizes AS MATERIALIZED (SELECT node, count(*) AS n FROM shingles GROUP BY node),
often AS MATERIALIZED (SELECT x, count(*) AS f FROM shingles GROUP BY x),
rare AS MATERIALIZED (
  SELECT node, x FROM (
    SELECT node, x, n, row_number() OVER (PARTITION BY node ORDER BY f, x) AS r
    FROM shingles JOIN often USING (x) JOIN sizes USING (node))
  WHERE r <= n // 5 + 1
), pairs AS MATERIALIZED (
  SELECT DISTINCT a.node AS a, b.node AS b
  FROM rare a JOIN rare b ON a.x = b.x AND a.node < b.node
  JOIN sizes l ON l.node = a.node JOIN sizes r ON r.node = b.node
  WHERE 100 * l.n >= 80 * r.n AND 100 * r.n >= 80 * l.n
), links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT a, b, count(*) AS s FROM pairs JOIN shingles x ON x.node = a JOIN shingles y ON y.node = b AND y.x = x.x
    GROUP BY a, b)
  JOIN sizes l ON l.node = a JOIN sizes r ON r.node = b WHERE 100 * s >= 80 * (l.n + r.n - s)
), ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS node, b AS other FROM ways
  UNION
  SELECT reach.node, ways.b FROM reach JOIN ways ON ways.a = reach.other
), heads AS (SELECT node, min(other) AS head FROM reach GROUP BY node),
classes AS (
  SELECT nodes.body, h.spot FROM nodes LEFT JOIN heads USING (node)
  JOIN nodes h ON h.node = least(nodes.node, coalesce(heads.head, nodes.node))
)
SELECT doc_id, line_no, spot // 10000000 AS class_doc, CAST(spot % 10000000 AS INTEGER) AS class_line,
       doc_id * 10000000 + line_no = spot AS kept
FROM lines JOIN classes USING (body)
"""


@query
def op7_lm_score(spark, sf):
    """Score all documents, learning from six sevenths of them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return lm.score_texts(table(spark, sf, "documents"), remainder(7) == 2, path)


URL_RULES = [
    urls.Rule("org/", "allow"),
    urls.Rule("example.org/es/", "block"),
    urls.Rule("example.org/en/1", "block"),
    urls.Rule("com/fr/", "allow"),
    urls.Rule("com/de/", "block"),
]


@query
def op2_url_filter(spark, sf):
    """Verdict on every page's url."""
    return urls.filter_urls(table(spark, sf, "pages"), URL_RULES)


@query
def op3_html_text(spark, sf):
    """Article of every page."""
    return html.extract(table(spark, sf, "pages"))


#: crc32 of a string expression {text}, by bytes; ``crc`` holds the table of remainders.
CRC_TABLE_SQL = """crc AS MATERIALIZED (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS t
  FROM range(256) r(i))"""
CRC_SQL = """xor(4294967295, list_reduce(
  list_concat([4294967295], list_transform(range(1, octet_length(encode({text})) + 1),
    lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


@query
def op11_spelling_variants(spark, sf):
    """Words of all texts under their most frequent near form; one letter left out by hash."""
    return spelling.spelling_variants(table(spark, sf, "documents"), shortest=6, fewest=5, times=5, slip=199)


#: Near words share what is left of both without a letter, at the same place for a replacement; a
#: word that lacks one is what is left of the other.
ORACLES["op11_spelling_variants"] = (
    "WITH RECURSIVE "
    + CRC_TABLE_SQL
    + """, runs AS MATERIALIZED (
  SELECT doc, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{6,}')) AS run
    FROM documents)
  GROUP BY doc, run
), hashed AS MATERIALIZED (SELECT run, n, """
    + CRC_SQL.format(text="doc || ':' || run")
    + """ AS h FROM runs, crc),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word
    FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cuts AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS form_n, arg_max(other, (n, -place)) AS form
  FROM (SELECT *, row_number() OVER (ORDER BY other) AS place FROM near) GROUP BY word
), formed AS MATERIALIZED (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN form_n >= 5 * words.n THEN form END AS form, CASE WHEN form_n >= 5 * words.n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), ways AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT ways.word, formed.form FROM ways JOIN formed ON formed.word = ways.at WHERE formed.form IS NOT NULL
), roots AS (
  SELECT ways.word, ways.at AS root FROM ways JOIN formed ON formed.word = ways.at WHERE formed.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""
)


@query
def op12_conversation_trie(spark, sf):
    """Trie of the conversations, each begun with the first turns of another one."""
    turns = trie.ordered_turns(table(spark, sf, "conversations"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return trie.trie(trie.rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 5, head, most=8))


ORACLES["op12_conversation_trie"] = (
    "WITH "
    + CRC_TABLE_SQL
    + """, turns AS MATERIALIZED (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), own AS MATERIALIZED (SELECT conv_id, list(said ORDER BY place) AS said FROM turns GROUP BY conv_id),
heads AS (SELECT conv_id, said, conv_id - conv_id % 5 AS base, CAST("""
    + CRC_SQL.format(text="CAST(conv_id AS VARCHAR)")
    + """ % 9 AS BIGINT) AS h FROM own, crc),
rebuilt AS MATERIALIZED (
  SELECT heads.conv_id, list_concat(coalesce(b.said, [])[1:h], heads.said[h + 1:]) AS said
  FROM heads LEFT JOIN own b ON b.conv_id = heads.base
), paths AS MATERIALIZED (
  SELECT conv_id, d, said[1:d] AS prefix, d = len(said) AS ends
  FROM (SELECT conv_id, said, unnest(range(0, len(said) + 1)) AS d FROM rebuilt)
), nodes AS MATERIALIZED (
  SELECT min(conv_id) AS node, d, prefix, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY d, prefix
), placed AS MATERIALIZED (SELECT p.conv_id, p.d, n.node FROM paths p JOIN nodes n ON p.d = n.d AND p.prefix = n.prefix),
parents AS MATERIALIZED (
  SELECT n.node, n.d, n.n_convs, n.ends_sha256, p.node AS parent,
         CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * octet_length(encode(n.prefix[n.d].text)) END AS saved
  FROM nodes n LEFT JOIN placed p ON p.conv_id = n.node AND p.d = n.d - 1
), kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM parents WHERE d > 0 GROUP BY 1, 2),
own_sums AS MATERIALIZED (
  SELECT p.node, p.d, saved, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN kids k ON k.node = p.node AND k.d = p.d
), sums AS (
  SELECT a.node, a.d, count(*) FILTER (WHERE o.n_children = 0) AS n_leaves, CAST(sum(o.saved) AS BIGINT) AS saved_tokens
  FROM own_sums o JOIN placed a ON a.conv_id = o.node AND a.d <= o.d
  GROUP BY a.node, a.d
)
SELECT p.node AS conv_id, p.d AS depth, p.parent AS parent_conv_id, p.n_convs, o.n_children, s.n_leaves, s.saved_tokens, p.ends_sha256
FROM parents p JOIN own_sums o ON o.node = p.node AND o.d = p.d JOIN sums s ON s.node = p.node AND s.d = p.d
"""
)


@query
def op13_quality(spark, sf):
    """Score all documents, learning from four fifths of the labelled ones."""
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels"), remainder(5) != 0)
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )
