"""Spelling variants, conversation tries and repeated substrings against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tollgate.llm import queries
from tollgate.llm.spelling import counted, neighbours, variants
from tollgate.llm.substrings import repeats
from tollgate.llm.tries import ordered, spliced, trie

DOCS = "doc_id long, text string, lang string, `a.b` string, WORD string, n string, removed string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "dots", "w", "n", "r") for i, t in rows], DOCS)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected_variants(counts, times=5):
    out = {}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("shard", [50_000, 7])
def test_variants_by_brute_force(spark, shard):
    rng = random.Random(shard)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(300)}
    words |= {"q" * 6 + x for x in ("", "a", "ab", "b")} | {"z" * 3000, "z" * 3001}
    counts = {w: 5 ** rng.randint(1, 5) for w in sorted(words)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants(table, shard=shard).collect()}
    assert got == expected_variants(counts)
    assert variants(table.limit(0)).count() == 0
    assert neighbours(table.limit(1)).count() == 0


def test_words_are_counted_by_brute_force(spark):
    rng = random.Random(3)
    pieces = ["Letter", "lettér", "ÀÉÎ×÷abc", "ab1cdefgh", "漢letters", "sıletter", " ", "\n", "-", "LETTER ", "abcdefgh", "long" * 30]
    rows = [(k if k % 9 else None, " ".join(rng.choice(pieces) for _ in range(40))) for k in range(300)] + [(7, None), (8, ""), (9, "Letter"), (9, "Letter")]
    want = Counter()
    for i, t in rows:
        run = ""
        for ch in (t or "") + " ":
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch.lower() if ch <= "Z" else ch
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
                run = ""
    got = {r.word: r.n for r in counted(documents(spark, rows)).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}


def expected_trie(rows, base=100):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(x)] for c, x in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(convs.get(c - c % base, [])[:h] + own[h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = Counter()
    for k, who in members.items():
        below = [x for x in members if x[: len(k)] == k]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        children = sum(len(x) == len(k) + 1 for x in below)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out[(min(who), len(k), min(members[k[:-1]]) if k else None, len(who), children, leaves, saved, digest)] += 1
    return out


def tried(spark, rows, per_range):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, `pos.a` string")
    conv = F.col("conv")
    turns = spliced(ordered(table), conv - conv % 100, F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(6)), 5)
    return Counter(tuple(r) for r in trie(turns, per_range).collect())


@pytest.mark.parametrize("per_range", [20_000, 9])
def test_trie_by_brute_force(spark, per_range):
    rng = random.Random(per_range)
    rows = []
    for c in [*range(60), *range(201, 230), 1000]:
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None])))
    rows += [(70 + k, t, "user", "common" * (t + 1)) for k in range(25) for t in range(7)]
    rows += [(3, None, "user", "first"), (4, 1, "user", "tie"), (4, 1, "user", "tie"), (None, 1, "user", "lost")]
    assert tried(spark, rows, per_range) == expected_trie(rows)


def test_trie_of_odd_tables(spark):
    assert not tried(spark, [], 9)
    one = [(c, 0, None, None) for c in (305, 309, 311)]  # bases that are absent: turnless where turns are replaced
    assert tried(spark, one, 9) == expected_trie(one)


def expected_repeats(rows, window):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    firsts = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                firsts[key] = min(firsts.get(key, i), i)
    out = Counter()
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and firsts[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def repeated(df):
    return Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), hashlib.sha256(r.kept.encode()).hexdigest() if r.kept is not None else r.words_sha256) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"shard": 40, "held": 60, "stream": 200}])
def test_repeats_by_brute_force(spark, sizes):
    rng = random.Random(11)
    words = [f"w{k}é" for k in range(400)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [some(n) for n in (49, 50, 51, 60, 120, 300)]
    hot = some(70)
    rows = []
    for k in range(160):
        text = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 40)
            text += p[a : a + rng.randint(30, 120)] + some(rng.randint(0, 3))
        if k % 3 == 0:
            text += hot + some(5)
        rows.append((rng.choice([k, k, k, 1000 - k, 5]), rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [(500 + k, rows[0][1]) for k in range(5)] + [(500, rows[0][1]), (7, None), (8, ""), (None, " ".join(hot)), (600, " ".join(["same"] * 200)), (601, " ".join(["same"] * 70)), (-1, " ".join(["same"] * 60))]
    near = [some(120) for _ in range(4)]
    rows += [(700 + k, " ".join(near[k % 4][:50] + hot[:30] + near[k % 4][50:])) for k in range(24)]
    assert repeated(repeats(documents(spark, rows), **sizes)) == expected_repeats(rows, 50)
    assert repeats(documents(spark, rows[:0])).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_contract_columns(spark):
    sf = SF
    kinds = {
        "op1_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
        "op2_simhash": "doc_id bigint, fingerprint string, component_id bigint",
        "op3_html": "page_id bigint, url string, text string, n_chars bigint",
        "op5_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        "op6_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
        "op7_quality": "doc_id bigint, held_out boolean, score double, predicted int",
        "op8_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op10_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
        "op11_spelling": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
        "op12_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
        "op13_substrings": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    }
    for name, want in kinds.items():
        got = queries.QUERIES[name](spark, sf)
        assert ", ".join(f"{k} {v}" for k, v in got.dtypes).startswith(want), name
        assert got.count()
