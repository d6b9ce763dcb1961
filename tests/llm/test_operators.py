"""Every operator against brute force, and its defined cases: nulls, empty and long texts, ties, repeated rows, empty tables,
extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import _arrays as A
from corpusloom.llm import sampled_pieces as SP
from corpusloom.llm import weighted_minhash as WM
from corpusloom.llm._labels import held_out
from corpusloom.llm._store import components
from corpusloom.llm._tokens import Tokens
from corpusloom.llm.best_fit import best_fit_pack, best_fit_runs
from corpusloom.llm.cnn_toxicity import toxicity_score, train_toxicity
from corpusloom.llm.crf_quality import quality_score, train_quality
from corpusloom.llm.itq import near_vectors
from corpusloom.llm.line_dedup import SHINGLE, duplicate_lines, remove_lines
from corpusloom.llm.line_frequency import line_frequency_rules
from corpusloom.llm.pfor import decode_blocks, decode_segment, encode_blocks, encode_segment, read_token_files, write_token_files
from corpusloom.llm.rlz import remove_duplicates
from corpusloom.llm.sampled_pieces import decode_pieces, encode_pieces, sample_pieces
from corpusloom.llm.weighted_minhash import near_duplicates

P = pytest.importorskip("public_tokenizers")
BPE, PIECES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, h string, bands string"


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(400)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    base, passage = " ".join(words(80, 1)), " ".join(words(60, 2))
    near = base.split()
    near[40] = "changed"
    rows = [base, base, " ".join(near), passage, f"intro {' '.join(words(30, 3))}\n{passage}\nend", None, "", " \n\t ", "one", "x " * 3000]
    rows += [" ".join(words(60, 100 + i)) + "\nShared boilerplate line of this site, all rights reserved.\n" + " ".join(words(30, 500 + i)) for i in range(12)]
    rows += ["É ß ﬁ 日本語\r\n\x0b\x0c <|endoftext|> it's", "word\n" * 5, base + "\n" + base]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 2}" if i % 7 else None, len(t or ""), "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id here " + " ".join(words(40, 9)), None, None, None, "", "", "", "")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_hashes_tell_spans_apart():
    data, off = A.utf8(pa.array(["ab ba ab", None, "ab"]))
    s, e = A.spans(data, off)
    h = A.span_hash(data, s, e)
    assert len(s) == 4 and h[0] == h[2] == h[3] != h[1]
    assert np.array_equal(np.searchsorted(s, off), [0, 3, 3, 4])


def test_long_words_cross_slices():
    long = "a" * (A._STEP + 100)
    data, off = A.utf8(pa.array([f"b {long} c", long]))
    s, e = A.spans(data, off)
    h = A.span_hash(data, s, e)
    assert h[1] == h[3] and h[0] != h[2]


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000, x) for x in range(1001, 1300)] + [(i, i + 1) for i in range(2000, 2040)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_frequency(docs, texts, empty):
    got = by_id(line_frequency_rules(docs, max_documents=4))
    for i, t in enumerate(texts):
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert any(r["n_frequent_words"] == 9 for r in got.values()) and all(r["kept"] for i, r in got.items() if i in range(10, 22))
    assert line_frequency_rules(empty).count() == 0


def test_depleted_documents_are_rejected(spark):
    text = "\n".join(" ".join(words(10, k)) for k in range(8))
    rows = spark.createDataFrame([(i, text, "s") for i in range(5)] + [(9, " ".join(words(90, 77)), "s")], "doc_id long, text string, source string")
    got = by_id(line_frequency_rules(rows, max_documents=4))
    assert not got[0]["kept"] and not got[0]["base_failed"] and got[9]["kept"]


def test_line_dedup(docs, texts, empty):
    found = duplicate_lines(docs)
    got = by_id(found)
    lines = []
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            norm = line.strip(" \t\r\x0b\x0c").lower()
            if norm:
                lines.append((i, k, norm))
    sets = {n: {n[j : j + SHINGLE] for j in range(max(1, len(n) - SHINGLE + 1))} for _, _, n in lines}
    parent = {n: n for n in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = list(sets)
    for x, a in enumerate(names):
        for b in names[x + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    seen, gone = set(), {i: [] for i in range(len(texts))}
    for i, k, n in lines:
        (gone[i].append(k) if find(n) in seen else seen.add(find(n)))
    assert {i: list(got[i]["removed_lines"]) for i in gone} == gone
    left = by_id(remove_lines(docs, found, ("doc_id", "lang")))
    for i, t in enumerate(texts):
        parts = (t or "").split("\n")
        assert left[i]["text"] == (t if not gone[i] else "\n".join(p for k, p in enumerate(parts) if k not in gone[i]))
    assert duplicate_lines(empty).count() == 0 and remove_lines(empty, duplicate_lines(empty)).count() == 0


def test_near_duplicates(docs, texts, empty, spark):
    got = by_id(near_duplicates(docs))
    assert got[0]["cluster_id"] == got[1]["cluster_id"] == got[2]["cluster_id"] == 0 and got[0]["kept"] and not got[1]["kept"]
    assert all(got[i]["cluster_id"] == i and got[i]["kept"] for i in (3, 5, 6, 7, 8, *range(10, 22)))
    assert got[None]["kept"] and got[None]["cluster_id"] is None
    assert near_duplicates(empty).count() == 0
    # a large group of near copies, and texts that share half with it
    base = words(150, 5)
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for k in random.Random(i).sample(range(150), 2):
            w[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:75] + words(75, 900 + i))) for i in range(40)]
    got = by_id(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(got[i]["cluster_id"] == 0 for i in range(120)) >= 119
    assert all(got[1000 + i]["kept"] for i in range(40))


def test_weighted_jaccard_and_samples():
    a = (np.array([1, 2, 5], np.uint64), np.array([1.0, 2, 3]))
    b = (np.array([2, 5, 9], np.uint64), np.array([1.0, 4, 2]))
    assert WM.weighted_jaccard(a, b) == pytest.approx((1 + 3) / (1 + 2 + 4 + 2))
    r = np.random.default_rng(1)
    x = np.sort(r.integers(1, 1 << 53, 300).astype(np.uint64))
    wa, wb = r.uniform(0.5, 3, 300), r.uniform(0.5, 3, 300)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    same = WM._samples(x, wa, np.array([0]), 2000)[0] == WM._samples(x, wb, np.array([0]), 2000)[0]
    assert abs(same.mean() - want) < 0.05


def brute_windows(rows, n=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if g in seen:
                gone[k : k + n] = [True] * n
            seen.add(g)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(a for a, b in zip(w, gone) if not b).encode()).hexdigest())
    return out


def test_rlz(docs, texts, empty):
    got = by_id(remove_duplicates(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("sha")))
    want = brute_windows(list(enumerate(texts)))
    assert {i: (got[i]["n_words"], got[i]["n_removed"], got[i]["sha"]) for i in want} == want
    assert got[4]["n_removed"] >= 60
    whole = by_id(remove_duplicates(docs, layout=True, columns=("lang",)))
    for i, t in enumerate(texts):
        if want[i][1] == 0:
            assert whole[i]["text"] == (t or "")
        assert len(WORD.findall(whole[i]["text"])) == want[i][0] - want[i][1]
    assert remove_duplicates(empty).count() == 0


def test_tokens_equal_the_library(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    odd = [t or "" for t in texts] + ["it's DOG's, <|endoftext|> a<|startoftext|>B", "Ça é ́x ΣΑΣ. 'tis' we'll!!! x.'s  y　z 1.5, a_b_", "Word.\x00 a\x1cb \x85c."]
    encoder = Tokens(BPE, 7)
    for _ in range(2):
        ids, off = encoder.encode(*A.utf8(pa.array(odd)))
        for i, t in enumerate(odd):
            assert ids[off[i] : off[i + 1]].tolist() == [*library.encode(t, add_special_tokens=False).ids, 7]


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    rows = best_fit_pack(docs, BPE, capacity=256).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 256) + 1
    mine = {(r["doc_id"], r["piece"]): r for r in rows}
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(-(-len(ids) // 256)):
            part = ids[256 * k : 256 * k + 256]
            r = mine[i, k]
            assert (r["start"], r["length"], r["ids_crc32"]) == (256 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert best_fit_pack(empty, BPE).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_runs_place_every_piece_once(seed):
    r = random.Random(seed)
    counts = {r.randrange(1, 101): r.randrange(1, 40) for _ in range(25)}
    runs, bins = best_fit_runs(counts, 100)
    fill = Counter()
    for length in counts:
        ranks = sorted(k for n, first, count, _, _ in runs.tolist() if n == length for k in range(first, first + count))
        assert ranks == list(range(counts[length]))
    spans = sorted((b + k, o, o + n) for n, _, count, b, o in runs.tolist() for k in range(count))
    for b, start, end in spans:
        assert fill[b] == start and end <= 100
        fill[b] = end
    assert len(fill) == bins


@pytest.mark.parametrize("values", [[], [5], [0, 2**32 - 1], list(range(1200)), [7] * 513, [1] * 500 + [60000] * 70])
def test_pfor_round_trip(values):
    ids = np.array(values, np.uint32)
    body, index = encode_blocks(ids)
    assert np.array_equal(decode_blocks(body, index, len(ids)), ids)
    raw = encode_segment(np.array([3, 4]), np.array([False, True]), np.array([0, len(ids), len(ids)]), ids)
    doc_ids, nulls, off, back = decode_segment(raw)
    assert doc_ids.tolist() == [3, 4] and nulls.tolist() == [False, True] and np.array_equal(back, ids)
    with pytest.raises(ValueError):
        decode_segment(raw[:-1] if len(ids) else raw[:20])


def test_token_files(docs, texts, empty, spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    write_token_files(docs, str(tmp_path / "a"), BPE)
    rows = sorted(read_token_files(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and ids[0] is None
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] is not None:
            want = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
            assert np.frombuffer(r["ids"], "<u4").tolist() == want
    write_token_files(empty, str(tmp_path / "b"), BPE)
    assert read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_sampled_pieces(docs, texts, empty):
    found = sample_pieces(docs, PIECES, k=3)
    rows = found.join(docs.select("doc_id", "text").distinct(), "doc_id").withColumn("back", decode_pieces("ids", PIECES)).collect()
    for r in rows:
        assert r["back"] == (r["text"] or "")
    per = Counter(r["doc_id"] for r in rows)
    assert per[5] == per[6] == 1 and per[0] == 3
    for i in (0, 3):
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["sample"])
        assert len({bytes(r["ids"]) for r in mine}) == 3
        assert [r["perturbed"] for r in mine] == sorted((r["perturbed"] for r in mine), reverse=True)
        assert all(0 < r["inclusion"] <= 1 and r["log_prob"] <= 0 for r in mine)

    def rounded(df):
        return sorted((str(r["doc_id"]), r["sample"], bytes(r["ids"]), *(round(r[c], 6) for c in ("log_prob", "perturbed", "inclusion"))) for r in df.collect())

    assert rounded(found) == rounded(sample_pieces(docs.repartition(7), PIECES, k=3))
    assert sample_pieces(empty, PIECES).count() == 0
    assert docs.where("doc_id = 3").select(decode_pieces(encode_pieces("text", PIECES), PIECES)).first()[0] == texts[3]


def test_samples_follow_the_lattice():
    n = 4000
    data, off = A.utf8(pa.array([" the cat"] * n))
    first, second = SP.sample_texts(SP.Lattice(PIECES), data, off, A.mix(np.arange(n, dtype=np.uint64)), 2)

    def draws(x):
        cuts = np.cumsum(x[2])[:-1]
        return [tuple(p.tolist()) for p in np.split(x[1], cuts)]

    a, b = draws(first), draws(second)
    p = {**dict(zip(b, np.exp(second[3]))), **dict(zip(a, np.exp(first[3])))}
    assert sum(p.values()) == pytest.approx(1, abs=0.01)
    counted, later = Counter(a), Counter(b)
    for s, q in p.items():
        assert abs(counted[s] / n - q) < 0.03
        assert abs(later[s] / n - sum(p[t] * q / (1 - p[t]) for t in p if t != s)) < 0.03


def test_near_vectors(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 24))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    for i in range(40):
        v = base[i % 5] + r.normal(size=24) * 0.02 * np.linalg.norm(base[i % 5]) / math.sqrt(24)
        rows.append((100 + i, v.tolist(), (i % 5) % 3))
    rows += [(200, base[0].tolist(), 0), (201, (base[0] * 7).tolist(), 0), (202, base[0].tolist(), None), (203, None, 0), (204, [0.0] * 24, 0), (205, [1.0, None] + [0.0] * 22, 0), (206, [float("nan")] * 24, 0), (207, [1e300] * 24, 0), (208, [], 0), (209, [1.0, 2.0], 0), (210, [2.0, 4.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit(1)).withColumn("keys", F.lit("x")).repartition(4)
    got = {x["vec_id"]: x for x in near_vectors(table).collect()}

    def usable(v):
        return v and None not in v and all(math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / math.sqrt((a @ a) * (b @ b))

    links = {i: {j for j, w, m in rows if j != i and k is not None and k == m and usable(v) and usable(w) and len(v) == len(w) and cosine(v, w) >= 0.98} for i, v, k in rows}
    assert {i: got[i]["n_links"] for i in links} == {i: len(x) for i, x in links.items()}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (i == min(seen))
    assert near_vectors(table.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "ka lo mi ne su ta".split() for b in "rin dol vex pam tur".split()]
    rows, marks = [], []
    for i in range(240):
        lines = [" ".join(r.choice(vocabulary) for _ in range(12)).capitalize() + "." for _ in range(4)]
        toxic, good = i % 3 == 0, i % 4 != 0
        if not good:
            lines = [line.upper().replace(" ", "!! ") for line in lines[:1] * 4]
        if toxic:
            lines[1] = lines[1].replace(" ", " idiot ", 1)
        rows.append((i, "\n".join(lines), "x", None))
        marks.append((i, int(good), int(toxic)))
    rows += [(1000, None, None, None), (1001, "", None, None), (None, "text", None, None)]
    marks += [(0, 0, 1), (5, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("train, score, label, cut", [(train_quality, quality_score, "quality", 0.5), (train_toxicity, toxicity_score, "toxic", 0.7)])
def test_classifiers(labelled, train, score, label, cut):
    docs, labels = labelled
    rows = docs.select("doc_id", held_out().alias("out"), score(train(docs, labels)).alias("p")).collect()
    truth = {r["doc_id"]: r[label] for r in labels.where(f"{label} is not null").collect()}
    right = [(r["p"] >= cut) == bool(truth[r["doc_id"]]) for r in rows if r["out"] and r["doc_id"] in truth and r["doc_id"] != 0]
    assert len(right) > 60 and sum(right) / len(right) > 0.95
    assert all(0 <= r["p"] <= 1 for r in rows) and len(rows) == 243
    assert all(r["out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    one = train(docs, labels.where(f"{label} = 1"))
    assert {r[0] >= 0.5 for r in docs.select(score(one)).collect()} == {True}
    assert {r[0] for r in docs.select(score(train(docs.limit(0), labels.limit(0)))).collect()} == {0.5}
    assert docs.limit(0).select(score(one)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(2)
    rows = [(i, "\n".join(" ".join(words(15, 7 * i + k)).capitalize() + "." for k in range(5)), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s", 0) for i in range(10)]
    rows += [(200 + i, "\n".join([" ".join(words(12, 3000 + i)).upper().replace(" ", "!! ")] * 4), "en", "s", 0) for i in range(40)]
    r.shuffle(rows)
    marks = [(i, int(i < 200), 0) for i, *_ in rows]
    rows += [next(x for x in rows if x[0] == 0), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]
    vectors = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0)], "vec_id long, embedding array<double>, label int")
    held = near_vectors(vectors)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert held.count() == 2  # the run touches no tables but its own
    assert {x["doc_id"] for x in got} - {None} == set(range(60))
    assert sum(x["doc_id"] == 0 and x["piece"] == 0 for x in got) == 1
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
