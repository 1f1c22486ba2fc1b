"""Ranked search, packing and spelling variants against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rivulet.llm import common, lexical, nearest, packing, registry, spelling

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path(registry.TOKENIZER)
DOCS = "doc_id long, text string, id long, n long, word string, key long, length long, score double"


def _docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 7, 7, "w", 1, 9, 0.5) for i, t in rows], DOCS)


# 11: ranked search
def _ranked(docs, items, k=20):
    """Every item against every document by the definition."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = [(i, Counter(term.findall((t or "").translate(lower)))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in terms]
    n, all_terms = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        asked = Counter(term.findall((text or "").translate(lower)))
        scored = []
        for (doc, c), length in zip(terms, lengths, strict=True):
            m = 100 - 25 + (25 * length * n) // max(all_terms, 1)
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k])]
    return out


def _rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_search_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = _rows(registry.op11_lexical_search(spark, SMALL))
    assert got == sorted(con.execute(lexical.ORACLE).fetchall()) and len(got) > 0


def test_search_of_odd_rows_in_small_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_CHARS", 60)
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 20)
    docs = [(1, "The cat, the CAT!"), (1, "The cat, the CAT!"), (None, "the cat"), (2, None), (3, ""), (4, " \n--"), (5, "É é cat\x00dog 7"), (6, "x " * 5_000 + "cat"), (7, "cat"), (8, "cat"), (None, None)]
    docs += [(i, "the same words again") for i in range(40, 10, -1)]
    items = [(1, "cat"), (1, "cat"), (2, "the the cat"), (3, None), (4, "é dog"), (5, "same words"), (5, "7 x"), (None, "cat"), (6, "no such")]
    found = lexical.search(_docs(spark, docs), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int"))
    want = _ranked(docs, dict.fromkeys(items))
    assert _rows(found) == sorted(want, key=lambda r: tuple((x is None, x or 0) for x in r))
    assert max(r[1] for r in want) == 20


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "cat")], "item_id long, text string")
    assert lexical.search(_docs(spark, []), items).count() == 0
    assert lexical.search(_docs(spark, [(1, None)]), items).count() == 0
    assert lexical.search(_docs(spark, [(1, "cat")]), items.limit(0)).count() == 0


def test_the_best_are_tie_safe():
    scores = np.array([0, 5, 7, 5, 5, 0, 9, 5])
    assert lexical.best(scores, 4).tolist() == [6, 2, 1, 3] and lexical.best(scores, 99).tolist() == [6, 2, 1, 3, 4, 7]
    assert lexical.best(np.zeros(9, np.int64), 3).tolist() == []


# 12: packing
def _pieces(docs, size):
    tokenizer, out = Tokenizer.from_file(TOKENIZER), []
    tokenizer.encode_special_tokens = True
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        ends = list(range(len(ids), 0, -size))[::-1]
        out += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip([0, *ends], ends))]
    return out


def _check_packing(packed: pd.DataFrame, size: int):
    for _, rows in packed.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= size


def test_pieces_and_their_places(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SMALL, "documents").collect()]
    got = registry.op12_packing(spark, SMALL).toPandas()
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(_pieces(docs, 1024))
    _check_packing(got, 1024)
    assert got.sequence_id.nunique() <= 1.02 * math.ceil(got.length.sum() / 1024)


def test_packing_of_odd_rows(spark):
    docs = [(1, "a b"), (1, "a b"), (2, None), (None, "x"), (None, None), (3, ""), (4, "wörd  <|endoftext|> \n\n z\t y " * 300), (5, "dash-" * 2_000), (6, " "), (7, "the " * 15), (8, "emoji \U0001f600 　 x\x1c y")]
    got = packing.pack(_docs(spark, docs), TOKENIZER, public_tokenizers.PATTERN, size=16).toPandas().astype(object)
    rows = sorted((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples() if not pd.isna(r.doc_id))
    assert rows == sorted(p for p in _pieces(docs, 16) if p[0] is not None)
    assert int(got.doc_id.isna().sum()) == sum(p[0] is None for p in _pieces(docs, 16))
    _check_packing(got, 16)
    assert packing.pack(_docs(spark, []), TOKENIZER, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 1024, 20_000), np.clip(rng.lognormal(5.5, 1, 9_000).astype(int), 1, 1023), rng.choice([300, 350, 400, 700], 5_000), np.r_[np.full(4_000, 613), rng.integers(1, 1024, 6_000)]][seed]
    histogram = Counter(lengths.tolist())
    plan, held = packing.solve(histogram), Counter()
    for made, times in plan:
        assert sum(made) <= 1024 and times > 0
        for length in made:
            held[length] += times
    assert held == histogram
    left = np.bincount(lengths, minlength=1025)
    assert sum(n for _, n in plan) <= 1.02 * sum(n for _, n in packing.best_fit(left, 1024))


def test_prices_find_the_best_filling():
    rng = np.random.default_rng(5)
    value = np.where(rng.random(25) < 0.4, rng.random(25), 0.0)
    worth, _ = packing.price(value, 24)
    best = [0.0]
    for room in range(1, 25):
        best.append(max([best[room - 1]] + [value[n] + best[room - n] for n in range(1, room + 1) if value[n] > 0]))
    assert np.allclose(worth, best)


# 13: spelling
def _variants(docs, letters=5, occurrences=3, times=2):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            counts[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= letters and c >= occurrences}
    near, blanks = defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            blanks[w[:i] + "*" + w[i + 1 :]].append(w)
            if (shorter := w[:i] + w[i + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for words in blanks.values():
        for w in words:
            near[w].update(x for x in words if x != w)
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= times * n[w] else None for w, f in form.items()}
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def _got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_of_the_documents(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, MIDDLE, "documents").collect()]
    got = registry.op13_spelling(spark, MIDDLE)
    rows = _got(got)
    assert rows == _variants(docs) and got.count() == len(rows)


@pytest.mark.parametrize("members", [1, 6, 1_000])
def test_variants_in_dense_groups(spark, monkeypatch, members):
    """Words over three letters, so that groups are large and split by letters; the result is the same."""
    monkeypatch.setattr(spelling, "MEMBERS", members)
    monkeypatch.setattr(spelling, "BUCKET", 40)
    rng = np.random.default_rng(3)
    text = [" ".join("".join(rng.choice(list("aBé"), rng.integers(5, 9))) for _ in range(400)) for _ in range(30)]
    docs = list(enumerate(text)) + [(None, text[0]), (None, None), (5, ""), (5, "--"), (9, text[1]), (9, text[1]), (10, "ab" * 2_000), (11, "ab" * 2_000), (12, "ab" * 2_000), (13, "ab" * 1_999 + "b"), (14, "ab" * 1_999 + "b"), (15, "ab" * 1_999 + "b")]
    got = _got(spelling.variants(_docs(spark, docs)))
    assert got == _variants(docs) and len(got) > 300 and any(v[0] for v in got.values())


def test_variants_of_empty_tables(spark):
    assert spelling.variants(_docs(spark, [])).count() == 0
    assert spelling.variants(_docs(spark, [(1, None), (2, "short few")])).count() == 0


def test_nearest_in_heaps_much_tighter_than_the_codes(spark):
    """Broad vectors and heaps a millionth as wide: within a heap the codes tell nothing, and every vector of a probed cell must still be found."""
    rng = np.random.default_rng(5)
    heaps = rng.normal(size=(3, 24))[rng.integers(0, 3, 2_000)] + 1e-6 * rng.normal(size=(2_000, 24))
    x = rng.permutation(np.concatenate([rng.normal(size=(3_000, 24)), heaps]))
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    found = nearest.search(rows).toPandas()
    hit = 0
    for q, mine in found.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(set(np.lexsort((np.arange(len(x)), d))[:10]) & set(mine.vec_id))
    assert len(found) == 500 and hit >= 475
