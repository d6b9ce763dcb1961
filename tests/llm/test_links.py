"""Near-dedup against the components of all pairs that share a band, on groups whose members are unlike their leaders."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from corpusloom.llm import _store
from corpusloom.llm import line_dedup as LD
from corpusloom.llm import weighted_minhash as WM
from corpusloom.llm.queries import op8_weighted_minhash


def partition(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def sharing(bands):
    """Pairs of the lists of bands that share one."""
    places = {}
    for i, own in enumerate(bands):
        for b in own:
            places.setdefault(b, []).append(i)
    return {p for x in places.values() for p in itertools.combinations(sorted(set(x)), 2)}


def by_band_pairs(spark, texts):
    often = WM.frequent_shingles(spark.createDataFrame([(t,) for t in texts], "text string"))
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(range(n)), pa.array(texts)], ["doc_id", "key", "id", "text"])
    bands = [b for x in WM._sign(often, WM.SHARE, WM.BANDS, WM.ROWS)(iter([batch])) for b in x.column("bands").to_pylist()]
    vectors = [(np.frombuffer(s, "<u8"), np.frombuffer(w, "<f8")) for x in WM._vector(often, WM.SHARE)(iter([batch])) for s, w in zip(x.column("shingles").to_pylist(), x.column("weights").to_pylist())]
    return partition(n, [(a, b) for a, b in sharing(bands) if WM.weighted_jaccard(vectors[a], vectors[b]) >= WM.THRESHOLD])


def clusters(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["cluster_id"] for r in WM.near_duplicates(rows).collect()}
    return [got[i] for i in range(len(texts))]


def test_pairs_among_many_unlike_members(spark):
    # twelve families whose texts are alike by 0.7, of 35 pairs alike by 0.82
    r, texts = random.Random(1), []
    for f in range(12):
        base = [f"family{f}x{i}" for i in range(130)]
        for i in range(35):
            own = [f"own{f}x{i}x{k}" for k in range(25)]
            texts += [" ".join(base + own), " ".join(base + [f"edit{w}" if k in (4, 11, 18) else w for k, w in enumerate(own)])]
    r.shuffle(texts)
    want = by_band_pairs(spark, texts)
    assert 420 <= len(set(want)) < 430
    assert clusters(spark, texts) == want


def test_chains_of_versions(spark):
    r = random.Random(2)
    texts = []
    for g in range(3):
        group = [[f"w{g}x{i}" for i in range(150)]]
        for i in range(199):
            w = list(r.choice(group))
            for k in r.sample(range(150), 3):
                w[k] = f"v{g}x{i}x{k}"
            group.append(w)
        texts += [" ".join(w) for w in group]
    assert clusters(spark, texts) == by_band_pairs(spark, texts)


def test_family_of_lines_with_frequent_shingles(spark):
    r = random.Random(3)
    slots = [["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(9)] for _ in range(3)]
    texts = [f"the measured values of station {a} in the quiet valley were read by {b} on the evening of the last day by {c} and then noted" for a, b, c in itertools.product(*slots)]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line long, norm string")
    bands = [[] for _ in texts]
    signed = LD._signatures(lines)
    for x in signed.collect():
        bands[x["line"]] += x["bands"]
    sets = [{t[j : j + LD.SHINGLE] for j in range(len(t) - LD.SHINGLE + 1)} for t in texts]
    want = partition(len(texts), [(a, b) for a, b in sharing(bands) if len(sets[a] & sets[b]) >= LD.THRESHOLD * len(sets[a] | sets[b])])
    got = {x["node"]: x["component"] for x in LD.line_components(lines, signed).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want


def template_rows():
    """Twelve templates of a hundred edited copies each, every copy alike its template, shuffled."""
    r, out = random.Random(11), []
    for f in range(12):
        base = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(3, 9))) + str(f) for _ in range(60)]
        out.append((f, " ".join(base)))
        for i in range(100):
            w = list(base)
            for k in r.sample(range(60), r.choice([1, 1, 1, 2])):
                w[k] = f"e{f}x{i}x{k}"
            out.append((f, " ".join(w)))
    r.shuffle(out)
    return out


def test_templates_of_lines(spark):
    rows = template_rows()
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_removed"] for r in LD.duplicate_lines(docs).collect()}
    assert sum(got.values()) == len({t for _, t in rows}) - 12 + len(rows) - len({t for _, t in rows})


def test_line_dedup_reads_its_texts_once(spark, tmp_path, monkeypatch):
    path, keep, reading = str(tmp_path / "documents.parquet"), LD.keep, []

    def noted(df, name, *rest):
        if any("documents.parquet" in f for f in df.inputFiles()):
            reading.append(name)
        return keep(df, name, *rest)

    monkeypatch.setattr(LD, "keep", noted)
    monkeypatch.setattr(_store, "keep", noted)
    same = "the measured values of the station in the quiet valley were read on the evening of the last day"
    rows = [(1, f"\n\n{same}"), (2, f"{same}.\n \n{same}!"), (3, None), (4, ""), (5, " \n\t"), (None, f"{same}\n"), (None, f"{same}\n"), (None, "\n\n\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = LD.duplicate_lines(spark.read.parquet(path)).collect()
    want = [(1, 3, 0, []), (2, 3, 2, [0, 2]), (3, 1, 0, []), (4, 1, 0, []), (5, 2, 0, []), (None, 2, 1, [0]), (None, 4, 0, [])]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((x["doc_id"], x["n_lines"], x["n_removed"], x["removed_lines"]) for x in got), key=order) == want
    assert reading == ["lines"]


def test_templates_of_documents(spark):
    rows = template_rows()
    texts = [t for _, t in rows]
    assert clusters(spark, texts) == by_band_pairs(spark, texts)


def counted_shingles(texts):
    """Each text's shingles with their counts, and the number of texts that hold each, without hashes."""
    own = [Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter() for w in (t.split() for t in texts)]
    return own, Counter(g for c in own for g in c)


def test_every_document_frequency_is_counted(spark, monkeypatch):
    monkeypatch.setattr(WM, "BLOCK_BYTES", 2000)
    r = random.Random(4)
    texts = ["", *(" ".join(r.choices("abcd", k=r.randrange(1, 60))) for _ in range(300))]
    own, df = counted_shingles(texts)
    rows = spark.createDataFrame([(i, i * 7919, t) for i, t in enumerate(texts)], "doc_id long, key long, text string").repartition(3)
    got = WM.counted_samples(rows, len(texts), sum(map(len, texts))).collect()
    assert len(got) == len(texts) and max(df.values()) > 10 > 1 == min(df.values())
    for x in got:
        assert sorted(np.frombuffer(bytes(x["dfs"]), "<u4").tolist()) == sorted(df[g] for g in own[x["doc_id"]])
        assert len(x["bands"] or []) == (WM.BANDS if x["n_words"] else 0)


def site_rows():
    """Of 700 texts, thirty share nine tenths of their words, less than a twentieth of all; five of those have a copy with one edit."""
    r, texts = random.Random(5), []
    base = [f"site{i}" for i in range(140)]
    for i in range(25):
        texts.append(" ".join(base + [f"own{i}x{k}" for k in range(14)]))
    for i in range(5):
        texts.append(" ".join([*base[:70], f"edit{i}", *base[71:], *(f"own{i}x{k}" for k in range(14))]))
    texts += [" ".join(f"other{i}x{k}" for k in range(r.randrange(1, 40))) for i in range(668)] + ["", None]
    r.shuffle(texts)
    return texts


def by_all_pairs(texts):
    own, df = counted_shingles([t or "" for t in texts])
    weight = [{g: n * math.log(1 + len(texts) / df[g]) for g, n in c.items()} for c in own]
    pairs = []
    for a, b in itertools.combinations([i for i, c in enumerate(own) if len(c) > 100], 2):
        low = sum(min(w, weight[b].get(g, 0)) for g, w in weight[a].items())
        if low >= 0.8 * (sum(weight[a].values()) + sum(weight[b].values()) - low):
            pairs.append((a, b))
    return partition(len(texts), pairs)


def test_near_duplicates_by_every_frequency(spark, tmp_path):
    texts = site_rows()
    want = by_all_pairs(texts)
    assert len(set(want)) == len(texts) - 5
    rows = list(enumerate(texts)) + [(k, texts[k]) for k in (3, 3, 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op8_weighted_minhash(spark, str(tmp_path)).collect()
    assert sorted((x["doc_id"], x["cluster_id"], x["kept"]) for x in got) == sorted((i, want[i], want[i] == i) for i, _ in rows)


def test_pipeline_weighs_by_every_frequency(spark):
    texts = site_rows()
    want = by_all_pairs(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.minhash_near_dedup(spark, docs, "")
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(set(want))
