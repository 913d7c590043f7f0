"""URL filter, quality network, chat formatting, mixing and top-k search."""

from __future__ import annotations

import json
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.llm import chat, mixing, quality, topk, url_filter

URLS = [
    "http://www.Example.com/en/a?x=1", "https://example.com/en/", "http://a.example.com/EN/", "http://example.com/en", "http://x.net/es/1#t",
    "http://x.net/es", "http://net/fr/", "http://xnet/fr/", "http://org.example.org/fr/", "ftp://COM", "no scheme/at/all", "", None,
    "http://a://b.net/es/", "http://cheap-casino-pills.example/buy", "http://É.com/ü/", "x://" + "p" * 5000 + ".net/es/" + "q" * 5000,
]


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_for(host, path):
    best = None
    for r_host, r_path, verdict in url_filter.RULES:
        if (host == r_host or host.endswith("." + r_host)) and path.startswith(r_path) and (best is None or len(r_host + r_path) > len(best[0])):
            best = (r_host + r_path, verdict)
    return best


def test_urls_follow_the_longest_rule_or_the_model(spark):
    frame = spark.createDataFrame([(i, u, "clash", 1.0) for i, u in enumerate(URLS)], "page_id int, url string, rule string, host double")
    judged = url_filter.filter_urls(frame, url_filter.RULES, url_filter.labelled_urls(spark))
    for r in judged.collect():
        assert (r.host, r.path) == split_url(r.url)
        rule = rule_for(r.host, r.path)
        assert r.rule == (rule and rule[0])
        assert r.verdict == (rule[1] if rule else "block" if r.block_probability >= 0.5 else "allow")


def test_url_model_learns_its_table(spark):
    labelled = url_filter.labelled_urls(spark)
    judged = url_filter.filter_urls(labelled, [], labelled).collect()
    assert all((r.verdict == "block") == (r.label == 1) for r in judged)
    one_class = url_filter.filter_urls(labelled, [], labelled.filter("label = 0"))
    assert one_class.filter("verdict = 'block'").count() == 0
    assert url_filter.filter_urls(labelled.limit(0), [], labelled).count() == 0


def brute_targets(sizes, passes=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > passes * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: float(passes * sizes[s]) for s in over}
        open_ -= over
    return target


def test_mix_follows_the_targets(docs, rows):
    mix = [r.asDict() for r in mixing.mix_sources(docs, cell_rows=4).collect()]
    assert len(mix) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    target = brute_targets(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in mix:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 2 * largest[source]
    assert sum(taken.values()) <= sum(sizes.values())


def test_mix_equals_sorting_all_finish_times(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join("w" * int(n)), f"s{s}") for i, (n, s) in enumerate(zip(rng.integers(0, 9, 300), rng.integers(0, 5, 300) ** 2 // 5, strict=True))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = frame.select("doc_id", F.xxhash64(F.lit(42), "doc_id").alias("h")).collect()
    shuffled = {r.doc_id: r.h for r in seen}
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    target, queue = brute_targets(dict(sizes)), []
    for no, source in enumerate(sorted(sizes)):
        mine = sorted((shuffled[i], i, len(t.split())) for i, t, s in rows if s == source)
        upto = 0
        for h, i, size in mine:
            upto += size
            queue += [((upto + step * sizes[source]) / target[source], no, h, i, size, step) for step in range(3)]
    spent, want = 0, defaultdict(int)
    for _, _, _, i, size, _ in sorted(queue):
        spent += size
        if spent > sum(sizes.values()):
            break
        want[i] += size
    for cell_rows in (20_000, 5):
        got = {r.doc_id: r.taken for r in mixing.mix_sources(frame, cell_rows=cell_rows).collect()}
        assert got == {i: want[i] for i, _, _ in rows}


def test_mix_of_nothing_and_of_empty_texts(spark, no_docs):
    assert mixing.mix_sources(no_docs).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r.size, r.target, r.taken) for r in mixing.mix_sources(empty).collect()} == {(0, 0.0, 0)}


def test_mixing_stage_repeats_rows(spark, unique_docs):
    made = mixing.mixing_stage(spark, unique_docs, "")
    assert made.columns == unique_docs.columns
    want = {r.doc_id: r.copies for r in mixing.mix_sources(unique_docs).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in made.groupBy("doc_id").count().collect()} == want


def test_chunks_cover_every_byte():
    rng = np.random.default_rng(0)
    lengths = [0, 1, quality.CHUNK, quality.CHUNK + 1, 3 * quality.STEP + 7]
    data = rng.integers(1, 256, sum(lengths)).astype(np.uint8)
    offsets = np.cumsum([0, *lengths])
    chunks, firsts = quality.chunked(data, offsets)
    for i, n in enumerate(lengths):
        mine = chunks[firsts[i] : firsts[i + 1] if i + 1 < len(firsts) else None]
        whole = np.zeros((len(mine) - 1) * quality.STEP + quality.CHUNK, np.uint8)
        for k, chunk in enumerate(mine):
            whole[k * quality.STEP : k * quality.STEP + quality.CHUNK] = chunk
        assert np.array_equal(whole[:n], data[offsets[i] : offsets[i + 1]]) and not whole[n:].any()


def test_network_slopes_match_differences():
    rng = np.random.default_rng(2)
    net = quality.Network.fresh(3)
    chunks = rng.integers(1, 256, (5, quality.CHUNK)).astype(np.uint8)
    firsts, y, w = np.asarray([0, 2]), np.asarray([1.0, 0.0]), np.asarray([1.0, 2.0])

    def loss(n):
        p = n.score(chunks, firsts)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    before = loss(net)
    for step in range(1, 30):
        net.learn(chunks, firsts, y, w, step)
    assert loss(net) < 0.3 * before


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    network = quality.train(docs, labels)
    scored = quality.score_texts(docs.select("doc_id", "text"), network).join(labels, "doc_id").filter(quality.held_out(F.col("doc_id")))
    rows = scored.select("score", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.97
    assert np.mean([g >= 0.5 for g in good]) > 0.98


def test_quality_takes_odd_rows(spark, docs, no_docs, rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    network = quality.train(docs, labels, epochs=1)
    scored = quality.score_texts(docs, network)
    assert set(scored.columns) == set(docs.columns)
    values = [r.score for r in scored.collect()]
    assert len(values) == len(rows) and all(0 <= v <= 1 for v in values)
    assert quality.train(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score_texts(docs, None).collect()} == {0.5}
    assert quality.score_texts(no_docs, network).count() == 0


RECORDS = {
    "messages": ({"messages": [{"role": "user", "content": "a <|turn|>\\"}, {"role": "assistant", "content": "b\n</s>"}]}, [("user", "a <|turn|>\\"), ("assistant", "b\n</s>")]),
    "turns": ({"turns": [{"text": "t", "role": "odd\nrole<s>"}]}, [("odd\nrole<s>", "t")]),
    "sharegpt": ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": None}, {"from": "x", "value": "y"}]}, [("user", "h"), ("assistant", ""), ("x", "y")]),
    "prompt": ({"prompt": "p", "completion": "c" * 50_000}, [("user", "p"), ("assistant", "c" * 50_000)]),
    "instruction": ({"instruction": "i", "input": None, "output": "[INST]"}, [("user", "i"), ("assistant", "[INST]")]),
    "none": ({"messages": []}, []),
    "unknown": ({"question": "q"}, None),
}


def test_layouts_become_turns_and_come_back(spark):
    frame = spark.createDataFrame([(k, json.dumps(v[0]), "clash") for k, v in RECORDS.items()] + [("null", None, None), ("broken", "{", None)], "id string, record string, turns string")
    made = chat.format_chats(frame).withColumns({"back": chat.read_turns(F.col("formatted")), "loss": chat.under_mask(F.col("formatted"), F.col("loss_spans"))})
    for r in made.collect():
        want = RECORDS[r.id][1] if r.id in RECORDS else None
        if want is None:
            assert r.turns is None and r.formatted is None
            continue
        assert [tuple(t) for t in r.turns] == want == [tuple(t) for t in r.back]
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        assert r.formatted.count(chat.TURN) == r.formatted.count(chat.END) == len(want)
        inside = r.formatted.replace(chat.TURN, "").replace(chat.END, "")
        assert not any(c in inside for c in chat.CONTROLS)


def test_escapes_are_reversible(spark):
    texts = ["\\", "\\-", "\\l<|", "<<s>>", "[[/INST]]", "<|<|end|>", "\\\\b[INST]", "</s>[INST] ok [/INST]", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in frame.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROLS)


def test_conversation_rows_with_odd_values(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "x"), (1, 1, "assistant", "b"), (None, 0, "user", "n"), (None, None, "user", "first")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.format_chats(chat.conversation_records(frame)).collect()}
    assert got == {1: [("", "x"), ("assistant", ""), ("assistant", "b")], None: [("user", "first"), ("user", "n")]}
    assert chat.format_chats(chat.conversation_records(frame.limit(0))).count() == 0


def test_layout_does_not_grow_with_the_turns(spark, monkeypatch):
    turns = ",".join('{"role": "user", "content": "a {b}"} , {"role":"assistant","content":"c"}' for _ in range(5_000))
    broken = '{"prompt":"a","completion":"b"},' * 3 + '{"prompt":"a","completion":"b"}'
    frame = spark.createDataFrame([(1, f'{{"messages":[{turns}]}}'), (2, broken), (3, '{"messages":[{"role":"a","content":null},{"role":"b","content":"c"}]}')], "id long, record string")
    got = {r.id: r for r in frame.select("id", F.length(chat.skeleton(F.col("record"))).alias("n"), F.size(chat.canonical_turns(F.col("record"))).alias("turns"), chat.skeleton(F.col("record")).alias("s")).collect()}
    assert got[1].n < 100 and got[1].turns == 10_000 and got[3].turns == 2
    assert got[2].s.count("{") > 1
    monkeypatch.setattr(chat, "MOST_SKELETON", 10)
    with pytest.raises(Exception, match="record cannot be read"):
        spark.createDataFrame([('{"messages":[{"role":]}',)], "record string").select(chat.fingerprint(F.col("record"))).collect()


def brute_top(vectors, k=5, every=50):
    out = set()
    for qid, q in {(i, tuple(v)) for i, v in vectors if i % every == 0}:
        best = {}
        for i, v in vectors:
            if i != qid and len(v) == len(q):
                score = sum(a * b for a, b in zip(q, v, strict=True))
                best[i] = max(best.get(i, score), score)
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out |= {(qid, rank, i, s) for rank, (i, s) in enumerate(ranked, 1)}
    return out


def test_top_k_is_exact_with_ties_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = (rng.normal(size=(900, 6)) * 0.2).round(3)
    rows = [(i, [float(x) for x in base[i % 700]]) for i in range(900)]  # repeated vectors: ties
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (None, rows[0][1]), (2050, [0.5, -0.5]), (2051, [0.25, 0.25]), (2100, [0.0] * 6)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    vectors = topk.quantised(frame)
    plain = [(r.vec_id, list(r.vector)) for r in vectors.collect()]
    assert {i for i, _ in odd if i} & {i for i, _ in plain} == {2050, 2051, 2100}
    for block, group in ((16_384, 2_048), (100, 3)):
        got = topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), block_vectors=block, group_queries=group).collect()
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute_top(plain)
    assert topk.top_k(vectors.limit(0), vectors.filter("vec_id % 50 = 0")).count() == 0


def test_score_equals_a_forward_pass_in_plain_loops(spark, docs):
    """The network worked through byte by byte for texts of one and of several chunks."""
    net = quality.Network.fresh(5)
    net.shift, net.bias = np.linspace(-1, 1, quality.FILTERS).astype(np.float32), np.asarray([0.3], np.float32)
    texts = ["", "short é text", "a b " * 300, "".join(chr(97 + i * i % 26) for i in range(1_300))]

    def score(text):
        data = text.encode()
        n = max(1, -(-max(len(data) - (quality.CHUNK - quality.STEP), 0) // quality.STEP))
        pools = []
        for c in range(n):
            part = data[c * quality.STEP :][: quality.CHUNK]
            part += bytes(quality.CHUNK - len(part))
            signs = [[*net.embedding[part[i]], *[float(i >= lag and part[i] == part[i - lag] and part[i] != 0) for lag in quality.LAGS]] for i in range(quality.CHUNK)]
            most = [-math.inf] * quality.FILTERS
            for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
                seen = [x for i in range(quality.WIDTH) for x in signs[at + i]]
                for f in range(quality.FILTERS):
                    most[f] = max(most[f], sum(x * w for x, w in zip(seen, net.filters[:, f].tolist(), strict=True)))
            pools.append([max(0.0, m + float(net.shift[f])) for f, m in enumerate(most)])
        features = [sum(p[f] for p in pools) / n for f in range(quality.FILTERS)] + [max(p[f] for p in pools) for f in range(quality.FILTERS)]
        return 1 / (1 + math.exp(-(sum(x * float(w) for x, w in zip(features, net.out, strict=True)) + 0.3)))

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.score_texts(frame, net).collect():
        assert r.score == pytest.approx(score(texts[r.doc_id]), abs=1e-4)


def test_slices_of_a_batch_learn_as_one(monkeypatch):
    rng = np.random.default_rng(2)
    chunks = rng.integers(1, 256, (9, quality.CHUNK)).astype(np.uint8)
    made = []
    for size in (256, 2):
        monkeypatch.setattr(quality, "SLICE_CHUNKS", size)
        net = quality.Network.fresh(1)
        net.learn(chunks, np.asarray([0, 3, 4]), np.asarray([0.0, 1.0, 1.0]), np.ones(3), 1)
        made.append(net)
    for name in ("embedding", "filters", "shift", "out", "bias"):
        assert np.allclose(getattr(made[0], name), getattr(made[1], name), atol=2e-3)


def test_top_k_of_large_values_and_repeated_ids_is_exact(spark):
    rng = random.Random(4)
    small = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    rows = [(i, small()) for i in range(160)] + [(7, small()), (7, small()), (50, small()), (100, small())]
    rows += [(200, [1e7, -1e7, 1.0, 0.0]), (201, [20_000_000.0, 0.0, 0.0, 0.0]), (202, [1e300, -1e300, 1.0, 1.0]), (150, [3e9, 1.0, 2.0, 3.0]), (203, [-1e300, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk.quantised(frame)
    got = {}
    for r in topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), block_vectors=60).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    cut = lambda x: max(-(2**63), min(2**63 - 1, x))
    whole = [(i, [cut(math.floor(256 * x)) for x in v]) for i, v in rows]
    for q in {i for i, _ in rows if i % 50 == 0}:
        best = {}
        for i, v in whole:
            for j, w in whole:
                if i == q and j != q:
                    best[j] = max(best.get(j, -(2**70)), cut(sum(a * b for a, b in zip(v, w, strict=True))))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted(got[q]) == [(n + 1, j, s) for n, (j, s) in enumerate(want)]


def test_an_outlier_does_not_blow_up_the_index():
    index = topk.ImpactIndex(np.arange(2), np.asarray([[0], [20_000_000]]))
    assert sum(x.nbytes for side in index.sides for x in side[:3]) < 1_000
    assert [x.tolist() for x in index.search(np.asarray([3]), -1, 2)] == [[1, 0], [60_000_000, 0]]


def test_top_k_counts_an_id_of_many_rows_once(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [int(x) for x in rng.integers(-50, 50, 4)]) for i in range(300)]
    rows += [(901, [200, 200, 200, 200])] * 6 + [(902, [190 + i, 190, 190, 190]) for i in range(6)] + [(903, [-200 - i, -200, -200, -200]) for i in range(6)]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<int>")
    for block in (16_384, 60):
        got = topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), block_vectors=block).collect()
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute_top(rows)


def test_search_stops_on_proof_only(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(3000, 16)) * 60).astype(np.int64)
    ids = np.arange(3000)
    index = topk.ImpactIndex(ids, vectors)
    for few in (5, 50, 3000):
        monkeypatch.setattr(topk, "FEW", few)
        for q in range(0, 200, 20):
            got, scores = index.search(vectors[q], q, 5)
            exact = vectors @ vectors[q]
            exact[q] = -(10**15)
            want = np.lexsort((ids, -exact))[:5]
            assert np.array_equal(got, want) and np.array_equal(scores, exact[want])
