"""The queries of the operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.bpe import bpe_round_trip
from tollgate.llm.common import table, table_path
from tollgate.llm.decontaminate import find_benchmark
from tollgate.llm.language import fit as fit_language
from tollgate.llm.language import held_out, identify
from tollgate.llm.licences import CUE, scan_licences
from tollgate.llm.neighbours import nearest
from tollgate.llm.private import pseudonymised
from tollgate.llm.quality import fit as fit_quality
from tollgate.llm.quality import scored
from tollgate.llm.simhash import near_duplicates
from tollgate.llm.spelling import counted, variants
from tollgate.llm.substrings import repeats
from tollgate.llm.token_counts import count_tokens
from tollgate.llm.tries import ordered, spliced, trie
from tollgate.llm.wrappers import extracted


def vocabulary() -> str:
    """The vocabulary file of the queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), table_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(documents: DataFrame) -> DataFrame:
    coded = bpe_round_trip(documents.select("doc_id", "text"), vocabulary())
    return coded.select("doc_id", F.col("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def language_model(documents: DataFrame):
    """A model of the rows whose crc32(doc_id) is not 2 modulo 4."""
    return fit_language(documents.filter(~held_out(F.col("doc_id"), 4, 2) & F.col("doc_id").isNotNull()), "text", "lang")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = identify(documents.select("doc_id", "text"), language_model(documents))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def secret_key(spark: SparkSession) -> str:
    """The key of pseudonyms, from tollgate.private.key; the queries' tables are synthetic, so they do with a known one."""
    return spark.conf.get("tollgate.private.key", None) or "key for synthetic tables"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), secret_key(spark))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit_quality(labels.filter(~held_out(F.col("doc_id"), 5, 0)), documents)
    return scored(documents, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extracted(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(as_files(table(spark, sf_dir, "documents")))


def as_files(documents: DataFrame) -> DataFrame:
    """doc_id, path and text: documents as files of source/group/, a thousand ids to a group.

    Texts of which a quarter of the words are in lines about licences are licence files: those of even ids of the
    source, the others of the group.
    """
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    about = F.array_join(F.filter(F.split("text", r"\n"), lambda s: s.rlike(CUE)), " ")
    licence = F.coalesce(F.col("text").rlike(CUE) & (words(about) * 4 >= words(F.col("text"))), F.lit(False))
    group = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.floor(F.col("doc_id") / 1000).cast("string"))
    path = F.when(licence & (F.col("doc_id") % 2 == 0), F.concat(F.coalesce("source", F.lit("none")), F.lit("/LICENSE"))).when(licence, F.concat(group, F.lit("/LICENSE"))).otherwise(F.concat(group, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return documents.select("doc_id", path.alias("path"), "text")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted(table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    heads = F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(6))
    return trie(spliced(ordered(table(spark, sf_dir, "conversations")), conv - conv % 100, heads, 5))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0), lambda n, s: n + s.end - s.start).cast("long")
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), F.coalesce(F.sha2(F.col("kept").cast("binary"), 256), "words_sha256").alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_html": op3_html,
    "op4_licences": op4_licences,
    "op5_bpe": op5_bpe,
    "op6_neighbours": op6_neighbours,
    "op7_quality": op7_quality,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op10_decontaminate": op10_decontaminate,
    "op11_spelling": op11_spelling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_substrings": op13_substrings,
}

WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: CRC-32 of the bytes that {bytes} lists, by its polynomial, bit by bit.
CRC = """xor(4294967295, list_reduce(list_concat([4294967295], {bytes}), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
DIGITS = "list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
#: The bytes of a text of Latin-1 letters.
LETTERS = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN ascii(x) < 128 THEN [CAST(ascii(x) AS BIGINT)] ELSE [CAST(192 + (ascii(x) >> 6) AS BIGINT), CAST(128 + (ascii(x) & 63) AS BIGINT)] END))"

#: Items' windows of each length are looked up among the documents' runs of as many words; hits are marked by place.
ORACLES: dict[str, str] = {
    "op10_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(10, len(w)) AS k, list_slice(w, i, i + least(10, len(w)) - 1) AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
runs AS (SELECT r, k, i, list_slice(w, i, i + k - 1) AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)),
hits AS (SELECT r, i, k, item FROM runs JOIN wins USING (k, win)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)""",
    "op11_spelling": f"""
WITH runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, {CRC.format(bytes="list_concat(" + DIGITS.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':'") + ", " + LETTERS.format("run") + ")")} AS h FROM runs),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM w)),
pairs AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN w ON w.word = l.rest UNION SELECT w.word, l.word FROM less l JOIN w ON w.word = l.rest),
near AS (SELECT p.word, count(*) AS n_near, max(v.n) AS best_n, min_by(p.other, (-v.n, p.other)) AS best FROM pairs p JOIN w v ON v.word = p.other GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM w LEFT JOIN near USING (word)),
way AS (WITH RECURSIVE r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root AND f.form IS NOT NULL) SELECT * FROM r)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM f JOIN way ON way.word = f.word JOIN f AS t ON t.word = way.root AND t.form IS NULL""",
    "op12_prefix_trie": f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(struct_pack(role := role, text := text) ORDER BY p) AS turns, {CRC.format(bytes=DIGITS.format("c"))} % 6 AS h FROM t GROUP BY c),
s AS (SELECT l.c, list_concat(CASE WHEN b.c IS NULL THEN [] ELSE b.turns[1:l.h] END, l.turns[l.h + 1:]) AS turns FROM l LEFT JOIN l b ON b.c = l.c - l.c % 100),
pre AS (SELECT c, d, turns[1:d] AS k, len(turns) = d AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM s)),
n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256, (count(*) - 1) * coalesce(length(k[d].text), 0) AS own FROM pre GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, k)),
sub AS (SELECT up, k[1:up] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM m) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN sub ON sub.up = m.d AND sub.k = m.k LEFT JOIN n u ON u.d = m.d - 1 AND u.k = m.k[1:m.d - 1]""",
    "op13_substrings": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
runs AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
firsts AS (SELECT k, min(doc_id) AS first FROM runs GROUP BY k),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 50)) AS p FROM runs JOIN firsts USING (k) WHERE first < doc_id) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_where(w, list_transform(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i))) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)""",
}
