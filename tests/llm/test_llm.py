"""Small cases with nulls, empty and repeated rows, and brute-force twins."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
from tidemark.llm import embedding_dedup, encoding, fingerprints, line_dedup, mixing, ngram_join, packing, quality, scan, token_counts, token_files, toxicity  # noqa: E402

R = random.Random(4)
WORDS = ["".join(R.choice("abcdefg") for _ in range(R.randrange(2, 7))) for _ in range(200)]
LONG = " ".join(R.choice(WORDS) for _ in range(30_000))
BASE = [R.choice(WORDS) for _ in range(120)]
TEXTS = [None, "", "  \n ", "one", "one two three", " ".join(BASE), " ".join(BASE[:-1] + ["x"]), " ".join(BASE).upper(), LONG] + [" ".join(R.choice(WORDS) for _ in range(R.randrange(5, 80))) for _ in range(40)]
SCHEMA = "doc_id long, text string, source string, n int, bits string, label string, size string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, [None, "a", "b", "c"][k % 4], 1, "x", "y", "z") for k, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def file(name):
    return token_counts.tokenizer_path(name)


def test_units_give_the_ids_of_the_whole_text():
    r = random.Random(1)
    bits = ["a", "Bc", "é", "ñ", " ", "  ", "\n", "\t", " ", "　", "!", ".", ",", "1", "'s", "'ll", "<|endoftext|>", "<", "|", ">", "́", "中", "Σ", "\x1c", "\x85", "​", "😀", "%%", "-"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 40))) for _ in range(4000)] + [LONG]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        whole = tokenizers.Tokenizer.from_file(file(name))
        own = encoding.Encoder(file(name), bits=9, store=4000)
        for lo, data, off in scan.texts(pa.array(texts), 5000):
            ids, at = own.encode(data, off)
            for k in range(len(at) - 1):
                assert ids[at[k] : at[k + 1]].tolist() == whole.encode(texts[lo + k], add_special_tokens=False).ids


def test_token_counts(docs, none):
    t = tokenizers.Tokenizer.from_file(file("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, file("word_bpe_49k.json")).collect()}
    assert got == {k: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for k, x in enumerate(TEXTS)}
    assert token_counts.token_counts(none, file("word_bpe_49k.json")).count() == 0


def test_ngram_join(docs, none):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, low = [shingles(t) for t in TEXTS], list(range(len(TEXTS)))
    for _ in sets:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and 100 * len(x & y) >= 75 * len(x | y):
                    low[a] = min(low[a], low[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs.unionByName(docs.filter("doc_id < 7"))).collect()}
    assert got == {k: (len(s), low[k]) for k, s in enumerate(sets)}
    assert ngram_join.near_duplicates(none).count() == 0


def test_tree_walk_finds_what_comparing_all_finds():
    r = np.random.default_rng(2)
    centres = r.integers(0, 1 << 60, (6, 80), dtype=np.uint64)
    sets = [np.unique(np.concatenate([c[: 80 - k % 14], r.integers(0, 1 << 60, k % 14, dtype=np.uint64)])) for c in centres for k in range(40)]
    import pandas as pd

    rows = pd.DataFrame({"gid": 1, "left": 0, "right": 0, "block": 0, "node": range(len(sets)), "first": [int(s[0]) for s in sets], "n": [len(s) for s in sets], "comp": range(len(sets)), "low": [[1]] * len(sets), "bits": [ngram_join.bitmap(s) for s in sets]})
    got = {tuple(p) for p in ngram_join._candidates(rows, None)[["a", "b"]].to_numpy().tolist()}
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                assert (b, a) in got


def test_line_dedup(spark, none):
    a = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"{a}\nshort line"), (2, f"{a} twelve\nshort line\nkept words that nobody else has at all"), (3, a.upper()), (4, None), (5, ""), (6, a.replace("five", "5"))]
    got = {r.doc_id: (r.text, r.n_removed, r.emptied) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (f"{a}\nshort line", 0, False), 2: ("short line\nkept words that nobody else has at all", 1, False), 3: ("", 1, True), 4: (None, 0, False), 5: ("", 0, False), 6: ("", 1, True)}
    assert line_dedup.dedup_lines(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.copies <= 2 for r in rows)
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        k = by.setdefault(r.key, [r.target, 0, 0, r.source_size])
        k[1], k[2] = k[1] + r.copies * r["size"], max(k[2], r["size"])
    assert abs(sum(k[0] for k in by.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(t - got) <= most and t <= 2 * size + 1e-6 for t, got, most, size in by.values())
    assert sorted(map(str, mixing.mix(docs.repartition(3)).collect())) == sorted(map(str, rows))
    assert mixing.mix(none).count() == 0


def test_packing(docs, none):
    tok = tokenizers.Tokenizer.from_file(file("byte_bpe_50k.json"))
    rows = packing.pack(packing.pieces(docs, file("byte_bpe_50k.json"))).collect()
    seq, own = {}, {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        own.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in seq.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 1024
    for k, t in enumerate(TEXTS):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert sum(p[2] for p in own[k]) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in own[k])
    assert packing.pack(packing.pieces(none, file("byte_bpe_50k.json"))).count() == 0


def test_bin_completion_beats_or_equals_best_fit():
    r, better = random.Random(3), 0
    for n in (1, 2, 40, 40, 40, 60, 1200, 1200, 1200, 4096):
        x = [min(1023, max(1, int(r.lognormvariate(6, 0.8)))) for _ in range(n)]
        bins, least = packing.complete(x)
        first = packing.best_fit(x, 1024)
        assert sorted(v for b in bins for v in b) == sorted(x) and all(sum(b) <= 1024 for b in bins)
        assert least <= len(bins) <= len(first)
        better += len(bins) < len(first)
    assert better


def test_bin_completion_finds_the_fewest_bins():
    r = random.Random(5)

    def fewest(x, rooms):
        """Brute force: the fewest bins of 20 for the descending lengths x."""
        if not x:
            return len(rooms)
        tries = [fewest(x[1:], rooms[:k] + [room - x[0]] + rooms[k + 1 :]) for k, room in enumerate(rooms) if room >= x[0] and room not in rooms[:k]]
        return min([*tries, fewest(x[1:], [*rooms, 20 - x[0]])])

    for _ in range(25):
        x = sorted((r.randrange(3, 13) for _ in range(8)), reverse=True)
        bins, least = packing.complete(x, 20)
        best = fewest(x, [])
        assert least <= best and len(bins) == best


def test_fillings_are_the_undominated_ones():
    r = random.Random(7)
    for _ in range(60):
        x, room = [r.randrange(1, 30) for _ in range(8)], r.randrange(5, 40)
        stock = packing.Stock(x, 40)
        subsets = {tuple(sorted((x[k] for k in range(8) if m >> k & 1), reverse=True)) for m in range(256)}
        fit = {s for s in subsets if sum(s) <= room}

        def covers(big, small):
            """Whether the pieces of `small` can be put into pieces of `big`."""
            if not small:
                return True
            return any(covers(big[:k] + (big[k] - small[0],) + big[k + 1 :], small[1:]) for k in range(len(big)) if big[k] >= small[0])

        want = {s for s in fit if not any(t != s and covers(t, s) for t in fit)}
        got = list(packing.fillings(stock, room, room, packing.Effort(10**6)))
        assert want <= set(got) and len(got) == len(set(got)) and stock.lengths() == sorted(x)
        assert [sum(g) for g in got] == sorted((sum(g) for g in got), reverse=True)
        if len(x) == len(set(x)):
            # Replacing by single pieces left over is what is tested, so a filling that only several pieces cover may stay.
            assert all(g in want or not any(covers((y,), p) for y in x if y not in g for p in [g] if y <= room) for g in got)
    assert list(packing.fillings(packing.Stock([500, 400, 300, 200, 100, 90, 50], 1024), 524, 524, packing.Effort(10**6))) == [(500,)]


def test_token_files_round_trip(docs, none, tmp_path):
    tok, start = tokenizers.Tokenizer.from_file(file("byte_bpe_50k.json")), 0
    token_files.write_ids(docs, file("byte_bpe_50k.json"), str(tmp_path / "t"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_documents(docs.sparkSession, str(tmp_path / "t")).collect()}
    for k, t in enumerate(TEXTS):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[k] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert docs.sparkSession.read.parquet(str(tmp_path / "t/index")).agg(F.sum("n_ids")).first()[0] == start
    every = [i for t in TEXTS for i in (*tok.encode(t or "", add_special_tokens=False).ids, 0)]
    for lo, hi in ((0, 5), (65_530, 65_545), (start - 3, start + 9), (7, 7)):
        part = sorted((r.position, r.id) for r in token_files.read_range(docs.sparkSession, str(tmp_path / "t"), lo, hi).collect())
        assert part == [(k, every[k]) for k in range(lo, min(hi, start))]
    again = docs.select(F.lit(None).cast("long").alias("doc_id"), "text").unionByName(docs.select("doc_id", "text")).unionByName(docs.select("doc_id", "text"))
    token_files.write_ids(again, file("byte_bpe_50k.json"), str(tmp_path / "r"))
    rows = sorted(token_files.read_documents(docs.sparkSession, str(tmp_path / "r")).collect(), key=lambda r: r.start)
    assert len(rows) == 3 * len(TEXTS) and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert [r.doc_id for r in rows] == [None] * len(TEXTS) + sorted([*range(len(TEXTS))] * 2)
    token_files.write_ids(none, file("byte_bpe_50k.json"), str(tmp_path / "n"))
    assert token_files.read_documents(docs.sparkSession, str(tmp_path / "n")).count() == 0


def test_fingerprints(docs, none):
    rows = {r.doc_id: r for r in fingerprints.compare(docs).collect()}
    assert len(rows) == len(TEXTS)
    assert rows[5].fingerprint == rows[7].fingerprint and rows[0].fingerprint == rows[1].fingerprint == ""
    w = TEXTS[5].lower().split()
    assert rows[5].n_shingles == len({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    assert rows[6].near_next > 0.9 and 0.1 < rows[8].near_edited < 0.6
    assert fingerprints.compare(none).count() == 0


def test_classifiers_learn(spark, none):
    r = random.Random(5)
    good = [" ".join(r.choice(WORDS) for _ in range(60)) for _ in range(240)]
    y = [k % 3 > 0 for k in range(240)]
    net = quality.train([t if v else t.upper().replace(" ", "!! ") for t, v in zip(good, y)], np.array(y))
    docs = spark.createDataFrame([(0, good[0]), (1, good[1].upper().replace(" ", "!! ")), (2, ""), (3, None)], "doc_id long, text string")
    s = {x.doc_id: x.score for x in quality.score(docs, net).collect()}
    assert s[0] > 0.8 > 0.3 > s[1] and s[2] == s[3] and 0 <= s[2] <= 1
    bad = [t if not v else t.replace(" ", " moronic ", 3) for t, v in zip(good, y)]
    model = toxicity.train(bad, np.array(y))
    docs = spark.createDataFrame([(0, good[0]), (1, good[1].replace(" ", " moronicc ", 4)), (2, ""), (3, None)], "doc_id long, text string")
    s = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert s[1] > s[0] and s[2] == s[3]
    assert quality.score(none, net).count() == 0 and toxicity.score(none, model).count() == 0


def test_embeddings(spark, monkeypatch):
    g = np.random.default_rng(1)
    base = g.normal(size=(30, 16))
    rows = [(k, (base[k % 30] + g.normal(scale=0.12, size=16)).tolist(), k % 2) for k in range(200)]
    rows += [(200, rows[0][1], 0), (201, None, 0), (202, [0.0] * 16, 0), (203, [float("nan")] + [1.0] * 15, 0), (204, rows[0][1], None), (205, [None] + [1.0] * 15, 0), (206, [], 0)]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = [r for r in rows if r[0] <= 200]
    x = np.array([r[1] for r in ok]) / np.linalg.norm([r[1] for r in ok], axis=1)[:, None]
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in ok])[:, None] == np.array([r[2] for r in ok]))
    degree = near.sum(1) - 1
    for block in (1024, 8):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame(rows)).collect()}
        hit = sum(got[k][0] == degree[k] for k in range(201))
        assert hit >= 0.97 * 201 and all(got[k][0] <= degree[k] for k in range(201))
        assert all(got[k] == (0, k, True) for k in range(201, 207))
    # One id with two vectors: each links for itself. No rows: no rows.
    twice = sorted(map(tuple, embedding_dedup.near_duplicates(frame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (3, [0.01, 1.0], 0)])).collect()))
    assert twice == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False)]
    assert embedding_dedup.near_duplicates(frame([])).count() == 0
