"""Operators on small tables with nulls, ties, repeats, clashing columns, and none."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from foliant.llm import chat, common, linededup, neighbours, packing, quality, shingles, simhash, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_lines int, fp string"
RUN = "alpha one\nbeta two\ngamma three"
LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, f"start\n{RUN}\nend", "en", "a", 9, "x"), (2, f"other\n{RUN}\n\nlast", "en", "a", 9, "x"), (3, None, None, None, None, None), (4, "", "en", "b", 0, ""),
    (5, LONG, "en", "b", 1, ""), (6, f"x\n {LONG}\t\ny", "en", "b", 1, ""), (7, "alpha one\nbeta two\nz", "en", "b", 1, ""), (None, "null id", "en", None, 1, ""), (7, "alpha one\nbeta two\nz", "en", "b", 1, ""),
]


def test_line_dedup(spark):
    got = defaultdict(list)
    for r in linededup.dedup_lines(spark.createDataFrame(ROWS, DOCS)).collect():
        got[r.doc_id].append((r.text, r.n_lines, r.n_removed))
    assert got[1] == [(ROWS[0][1], 5, 0)] and got[2] == [("other\n\nlast", 6, 3)] and got[3] == [(None, 0, 0)] and got[4] == [("", 1, 0)]
    assert got[5] == [(LONG, 1, 0)] and got[6] == [("x\ny", 3, 1)] and got[7] == [(ROWS[6][1], 3, 0)] * 2 and len(got[None]) == 1
    assert linededup.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_simhash_hot_keys_agree(spark):
    rng, base = np.random.default_rng(3), 0x0123456789ABCDEF
    fps = {base ^ sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for k in rng.integers(0, 5, 150)} | {int(x) for x in rng.integers(1, 1 << 62, 50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in signed:
        for y in signed:
            if x < y and ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 2:
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    for hot in (512, 2):
        from foliant.llm.components import connected_components

        got = {r.node: r.root for r in connected_components(simhash.links(df, hot)).collect()}
        assert {x: got.get(x, x) for x in signed} == {x: root(x) for x in signed}


def test_simhash_keys_are_not_broadcast(spark):
    """A fingerprint's keys and words take up to 65 rows, which Spark's estimate of a join's sides does not know."""
    fps = spark.createDataFrame([(i * 7919,) for i in range(50)], "fp long")
    found = simhash.links(fps)._jdf.queryExecution().optimizedPlan()
    ball = simhash._ball_links(fps)._jdf.queryExecution().optimizedPlan()
    assert all("strategy=merge" in plan.toString() for plan in (found, ball))


def test_shingle_pairs_are_not_broadcast(spark, monkeypatch):
    """What a set's pairs are checked by is far larger than its file: no plan may broadcast it by the driver."""
    plans, kept = [], shingles.stash
    monkeypatch.setattr(shingles, "stash", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or kept(df, name))
    texts = [(i, " ".join(f"w{j}" for j in range(i % 3, 40))) for i in range(12)]
    assert len({r.root for r in shingles.groups(spark.createDataFrame(texts, "row_ long, text string")).collect()}) == 1
    assert all("strategy=merge" in p for n, p in plans if n in ("shingle-maybe", "shingle-near"))


def test_components_contract(spark):
    from foliant.llm.components import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long"), finish_edges=0).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_simhash_edges(spark):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(ROWS, DOCS)).collect())
    assert len(got) == len(ROWS) and (3, 3) in got and (4, 3) in got and got.count((7, 7)) == 2
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_representatives_of_null_and_shared_ids(spark):
    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in "abcde"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (2, texts[2]), (0, texts[3]), (3, texts[4]), (3, texts[4]), (None, texts[4])]
    got = sorted(((r.doc_id, r.text) for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == sorted([(None, texts[0]), (None, texts[1]), (1, texts[2]), (0, texts[3]), (3, texts[4])], key=str)


def test_packing(spark):
    rows = [*ROWS, *[(10 + i, f"word{i} it's  text\n{i} " * (1 + i * 7 % 90), "en", f"s{i % 5}", 0, "") for i in range(60)]]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), {"s1": 3.0, "s2": 1.0}, window=256).collect()
    codec = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    codec.encode_special_tokens = True
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, text, *_ in rows[9:]:
        ids, at = np.array([*codec.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s, own in seqs.items():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 256 or s == max(seqs)
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []


def test_packing_small_sources(spark):
    """Sources of under a token a window take turns; named ones get their target."""
    rows = [(i, " ".join(["word"] * (19 + i % 3 * 40)), f"s{i % 50:02}") for i in range(400)] + [(1000, " ".join(["rare"] * 30), "rare"), (1001, " ".join(["big"] * 9000), "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for weights in (None, {"big": 1.0}):
        got = packing.pack(df.where("source <> 'rare'"), weights, window=16).collect()
        assert sum(r.length for r in got) == sum(r.doc_tokens for r in {r.doc_id: r for r in got}.values())
        places = [(r.sequence_id * 16 + r.offset, r.source, r.length) for r in got if r.source != "big"]
        whole, given, at = defaultdict(int), defaultdict(int), 0
        for _, s, n in places:
            whole[s] += n
        everything = sum(whole.values())
        for _, s, n in sorted(places):
            given[s] += n
            at += n
            assert all(abs(given[x] - whole[x] * at / everything) <= 40 for x in whole)
        docs = defaultdict(list)
        for r in got:
            docs[r.doc_id].append((r.start, r.length, r.doc_tokens))
        for own in docs.values():
            at = 0
            for start, length, _ in sorted(own):
                assert start == at
                at += length
            assert at == own[0][2]
    given = defaultdict(int)
    for r in packing.pack(df, {"rare": 0.3, "big": 0.7}, window=100).where("sequence_id = 0").collect():
        given[r.source] += r.length
    assert abs(given["rare"] - 30) <= 1 and abs(given["big"] - 70) <= 1


def test_packing_added_tokens(spark):
    """Ids as the library gives them by its default settings."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "it's <|endoftext|>\n\n y  ", "<|endoftext| >", "plain  text \n"]
    codec = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in packing.pack(spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()}
    assert got == {i: [*codec.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_quality(spark):
    good, bad = "The plain words of a text, with ends. ", "SHOUT!! $$$ %%% ### | x | "
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) * (1 + i % 7), "en", "a", 1, "") for i in range(80)] + [(90, None, "en", "a", 1, ""), (None, good, "en", "a", 1, "")], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (5, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.scores(docs, model).collect()}
    assert all((got[i] >= quality.CUT) == bool(i % 2) for i in range(80)) and 0 <= got[90] <= 1
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} >= set(range(1, 80, 2))
    assert quality.train(docs, labels.where("quality = 1")) is None


def test_warc(spark):
    rows = [(1, "http://a.com/x", "hi", "c"), (2, "http://a.com/x", "hi", "c"), (3, None, None, "c"), (4, "http://b.a.com/y z\n", "é", "c"), (None, "http://q", "hi", "c"), (2, "http://a.com/x", "hi", "c")]
    kind = "page_id long, url string, html string, digest string"
    archive = warc.write(spark.createDataFrame(rows, kind))
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.scan(archive).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 2, "revisit", 2), (2, 2, "response", None), (2, 2, "response", None), (3, 0, "response", None), (4, 2, "response", None), (None, 2, "revisit", 2)]))
    assert {r.page_id for r in warc.lookup(archive, spark.createDataFrame([("http://A.com/x#f",), ("http://zz/",)], "url string")).collect()} == {1, 2}
    assert {r.page_id for r in warc.scan(archive, "com,a)", "com,a)~").collect()} == {1, 2}
    assert warc.scan(warc.write(spark.createDataFrame([], kind))).collect() == []


def test_chat(spark):
    rows = [(1, True, 0, "user", "q"), (1, True, 1, "assistant", "good"), (1, False, 0, "user", "q"), (1, False, 1, "assistant", "bad"), (2, True, None, None, None), (None, True, 0, "user", "x")]
    got = {r.pair_id: r for r in chat.format_preferences(spark.createDataFrame(rows, "pair_id long, chosen boolean, turn long, role string, text string")).collect()}
    assert got[1].prefix_turns == 1 and got[1].prompt == "<|user|>\nq<|end|>\n" and got[1].rejected == "<|assistant|>\nbad<|end|>\n"
    assert got[1].rejected_mask == "0" * 14 + "1" * 11 and len(got[1].chosen_mask) == len(got[1].chosen)
    assert set(got) == {1, 2} and got[2].rejected is None and got[2].prompt == ""


def test_topk_and_neighbours(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in base[i // 3] + rng.normal(size=8) * 0.02], i % 2, "c") for i in range(120)] + [(200, None, 1, "c"), (201, [0.0] * 8, 1, "c"), (202, [float("nan")] * 8, 1, "c"), (203, [1.0] * 8, None, "c"), (4, rows_4 := [1.0, 2.0], 0, "c")]
    del rows_4
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string")
    q = topk.quantised(df)
    got = defaultdict(list)
    for r in topk.top_k(q, q.where("vec_id % 10 = 0 and dim = 8"), 5, shard=30).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v, *_ in rows if v and len(v) == 8 and np.isfinite(v).all()}
    for i, found in got.items():
        want = sorted(((-sum(a * b for a, b in zip(ints[i], ints[j])), j) for j in ints if j != i))[:5]
        assert found == [(j, -s) for s, j in want]
    near = {(r.vec_id, r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect()}
    fine = [(i, np.array(v), lab) for i, v, lab, _ in rows if v and lab is not None and np.isfinite(v).all() and any(v)]
    links = {i: sum(j != i and lab == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98 for j, w, m in fine) for i, v, lab in fine if len(v) == 8}
    assert all(n == links[i] for i, n, c in near if i in links and i != 4) and {(200, 0, 200), (201, 0, 201), (202, 0, 202), (203, 0, 203)} <= near
    assert neighbours.near_duplicates(df.where("false")).collect() == []


def test_neighbours_beyond_the_lists_and_rounds(spark):
    """Two tight groups linked across, each larger than a list; and small groups beside a hot one, with no search to find them."""
    rng = np.random.default_rng(6)
    a, b = np.eye(16)[0], np.eye(16)[0] + 0.17 * np.eye(16)[1]
    tight = [base + rng.normal(size=16) * 0.0005 for base in (a, b) for _ in range(100)]
    pairs = [base + rng.normal(size=16) * 0.01 for base in rng.normal(size=(30, 16)) for _ in range(2)]
    x = np.array(tight + pairs)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.98
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")

    def check():
        got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect()}
        assert got == {i: (int(close[i].sum()) - 1, int(np.flatnonzero(close[i]).min())) for i in range(len(x))}

    assert close[:200, :200].all()
    check()
    was = neighbours.ROUNDS, neighbours.STRETCH, neighbours.BLOCK
    try:
        neighbours.ROUNDS, neighbours.STRETCH, neighbours.BLOCK = 0, 2, 50
        check()
    finally:
        neighbours.ROUNDS, neighbours.STRETCH, neighbours.BLOCK = was


def test_line_dedup_clashing_columns(spark):
    """Columns that bear the operator's own names come back as they were; rows of one id and different texts are two documents."""
    kind = "doc_id long, text string, _k string, _out int, _lines int, k_ int, lines_ int, doc_ int, fp int, `a.b` int"
    rows = [(1, f"start\n{RUN}", "k", 1, 2, 3, 4, 5, 6, 7), (1, f"other\n{RUN}\nx", "m", 1, 2, 3, 4, 5, 6, 8), (None, f"none\n{RUN}", "n", 1, 2, 3, 4, 5, 6, 9)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, kind)).collect()
    assert sorted(tuple(r)[2:10] for r in got) == sorted(r[2:] for r in rows)
    assert sorted(r.n_removed for r in got) == [0, 3, 3] and next(r for r in got if r.doc_id is None).n_removed == 0


def test_line_dedup_hot_runs(spark, monkeypatch):
    """Runs joined by broadcast give what all others give."""
    df = spark.createDataFrame([(i, f"a{i}\n{RUN}\nb{i}" if i % 3 else f"c{i}\nd\ne{i % 6}\nf") for i in range(60)], "doc_id long, text string")
    want = sorted(tuple(r) for r in linededup.dedup_lines(df).collect())
    monkeypatch.setattr(linededup, "HOT", 1)
    assert sorted(tuple(r) for r in linededup.dedup_lines(df).collect()) == want and sum(r[3] > 0 for r in want) == 39 + 18


def test_quality_against_plain_fit(spark):
    """The registered query on sf0.01 against features, fit and quantile worked out without Spark."""
    from foliant.llm import queries

    sf = "/root/testdata/sf0.01"
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality in (0, 1) and not held(r.doc_id)}
    xs = [np.array([quality.features(texts[i]) for i in sorted(labels) if labels[i] == q and i in texts]) for q in (0, 1)]
    share = sum(labels.values()) / len(labels)
    x = np.concatenate([xs[1], xs[0]]).astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    b, w = (np.clip((y - mean) / scale, -8, 8) for y in (xs[1], xs[0]))
    rng, weight, m, v = np.random.default_rng(7), np.zeros(x.shape[1]), 0, 0
    for i in range(1, 301):
        grad = 1e-3 * weight
        left, right = rng.integers(len(b), size=2048), rng.integers(len(w), size=2048)
        for d in [b[left] - w[right]]:
            grad = grad - (d.T @ (1 / (1 + np.exp(np.clip(d @ weight, -50, 50))))) / len(d)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        weight = weight - 0.02 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    raw = sorted([(s, share / len(b)) for s in b @ weight] + [(s, (1 - share) / len(w)) for s in w @ weight])
    below, at = 0.0, None
    for (s, mass), (after, _) in zip(raw, raw[1:]):
        below += mass
        if below <= 1 - share + 1e-9:
            at = (s + after) / 2
    got = queries.QUERIES["op5_bradley_terry"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        z = np.clip((quality.features(texts[r.doc_id]).astype(np.float64) - mean) / scale, -8, 8) @ weight
        want = 1 / (1 + np.exp(-(z - at + np.log(0.7 / 0.3))))
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id)
    good = [x for x in got if x.doc_id in labels and not x.held_out]
    assert abs(sum(x.predicted for x in good) - sum(labels[x.doc_id] for x in good)) <= 1  # the quantile: as many pass as are good


def test_quality_learns_from_all_labels(spark, monkeypatch):
    """More labelled documents than a block holds: mean, weights and threshold are those of all of them."""
    good, bad = [f"Plain words, number {i}, of text {i % 97}. " * (1 + i % 3) for i in range(9000)], [f"SHOUT {i} $$ | %% " * (1 + i % 5) for i in range(30)]
    docs = spark.createDataFrame([*enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 9000)) for i in range(9030)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    x = np.array([quality.features(t.encode()) for t in good + bad]).astype(np.float64)
    assert np.allclose(model.mean, x.mean(axis=0), atol=1e-9) and np.allclose(model.scale, x.std(axis=0) + 1e-3, atol=1e-9)
    score = model.score(x)
    assert sum(score >= quality.CUT) == 9000 and min(score[:9000]) > max(score[9000:])
    monkeypatch.setattr(quality, "LISTED", 50)
    raw = [(i % 2, float((i * 7919) % 1000 // 10)) for i in range(1000)] + [(0, 31.0)] * 300
    mass = {0: 0.3 / 800, 1: 0.7 / 500}
    for q in (0.0, 0.1, 0.303, 0.31, 0.5, 0.9999, 1.0):
        upto, before, want = 0.0, None, None
        for v, k in sorted(((v, k) for k, v in raw), key=lambda r: (r[0], -r[1])):
            upto += mass[k]
            if upto > q + 1e-9:
                want = v if before is None else (before + v) / 2
                break
            before = v
        assert quality.weighted_quantile(spark.createDataFrame(raw, "q int, raw double"), mass, q) == (before if want is None else want)


def test_warc_many_blocks_and_files(spark, monkeypatch):
    """Look-ups over many archive files, index files, blocks of one hot key and spans of the directory, against a plain list."""
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    rows = [(i, "http://hot.example.org/" if i % 3 == 0 else f"http://h{i % 7}.example.org/p{i % 40}", f"body {i % 50} " * 20) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    base = warc.scratch_path(spark, "warc-test")
    captures = warc.write_archives(pages, base)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    archive = warc.Archive(base, captures, warc.build_index(captures, base, block_lines=7))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert archive.directory.count() > 50 and archive.directory.select("file").distinct().count() > 1 and captures.select("file").distinct().count() > 10
    for parts in (1, 9, 4096):
        asked = ["http://hot.example.org/", "http://H3.example.org/p3#x", "http://hot.example.org/", "http://nowhere/", None, "http://h0.example.org/p0"]
        got = warc.lookup(archive, spark.createDataFrame([(u,) for u in asked], "url string"), payloads=True, parts=parts).collect()
        want = sorted(i for i, u, _ in rows if u in ("http://hot.example.org/", "http://h3.example.org/p3", "http://h0.example.org/p0"))
        assert sorted(r.page_id for r in got) == want
        assert all(bytes(r.payload).decode() == (rows[r.page_id][2] if r.record_type == "response" else "") for r in got)
    got = [i for i, *_ in warc.lookup(archive, pages).select("page_id").collect()]
    assert sorted(got) == list(range(400))


def test_workers_forget_the_tokenizer(spark):
    """A worker that has packed holds its table of chunks for the next task of that kind, but not through another operator's."""
    docs = spark.range(0, 64, 1, 16).selectExpr("id as doc_id", "'s' as source", "repeat(concat(' word', id), 9) as text")
    packing.tokenized(docs, packing.default_vocabulary()).collect()

    def held(batch):
        return pa.RecordBatch.from_arrays([pa.array([packing.encoder.cache_info().currsize], pa.int64())], ["held"])

    assert {r.held for r in common.arrow_map(docs, held, "held long").collect()} == {0}
