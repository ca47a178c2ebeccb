"""Contracts of the operators: models against plain versions, odd cases, clashing columns, concurrent writers, and the whole pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import attention_lm, language_id, line_dedup, matroska, mixing, ngram_join, packing, sharding, suffix_dedup, vector_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_bits(sample, word, order=language_id.ORDER):
    """Interpolated Kneser-Ney, gram by gram."""
    raw = [Counter() for _ in range(order + 2)]
    for w in sample:
        s = f"\0{w}\0"
        for i in range(1, len(s)):
            for n in range(1, min(order, i + 1) + 1):
                raw[n][s[i - n + 1 : i + 1]] += 1
    gain, leave = [{} for _ in range(order + 1)], [{} for _ in range(order + 1)]
    for n in range(1, order + 1):
        before = Counter(g[1:] for g in raw[n + 1]) if n < order else {}
        counts = {g: before.get(g, 0) or c for g, c in raw[n].items()}
        ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        total, types = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            types[g[:-1]] += 1
        gain[n] = {g: max(c - discount, 0) / total[g[:-1]] for g, c in counts.items()}
        leave[n] = {c: discount * types[c] / t for c, t in total.items()}
    s, bits = f"\0{word}\0", 0.0
    for i in range(1, len(s)):
        p = leave[1][""] / 400
        for n in range(1, order + 1):
            if i - n + 1 < 0:
                break
            if n > 1:
                p *= leave[n].get(s[i - n + 1 : i], 1.0)
            p += gain[n].get(s[i - n + 1 : i + 1], 0.0)
        bits -= math.log2(p)
    return bits


def test_language_models_against_plain_kneser_ney():
    rnd = random.Random(4)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9)))
    samples = {"aa": [word("abcdeé") for _ in range(200)], "bb": [word("xyzaß") for _ in range(90)]}
    models = language_id.Models().fit({k: pa.array([" ".join(v)], pa.large_string()) for k, v in samples.items()})
    asked = [word("abcxyzéq") for _ in range(60)] + ["a", "q"]
    bits, sizes = models.word_bits(pa.array(asked, pa.large_string()))
    for k, lang in enumerate(models.languages):
        assert bits[:, k] == pytest.approx([plain_bits(samples[lang], w) for w in asked], rel=1e-3)
    assert sizes.tolist() == [len(w) + 1 for w in asked]


def test_language_of_odd_texts(spark):
    rnd = random.Random(2)
    kinds = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["xyzzy", "qwop", "zork"]}
    known = [(i, " ".join(rnd.choice(kinds[("aa", "bb")[i % 2]]) for _ in range(20)), ("aa", "bb")[i % 2], "s", 1) for i in range(80)]
    models = language_id.fit(spark.createDataFrame(known, SCHEMA))
    odd = [(1, "lorem " * 200_000, None, None, None), (1, "lorem " * 200_000, "bb", "x", 2), (None, "zork qwop", "aa", None, 1), (3, "12 !", "aa", "s", 1)]
    got = language_id.identify(spark.createDataFrame(odd, SCHEMA).withColumns({"score": F.lit("clash"), "bits": F.lit(7)}), models).collect()
    assert [r["lang_pred"] for r in got] == ["aa", "aa", "bb", "und"] and got[0]["score"] == got[1]["score"] == 1.0
    tie = models.predict(pa.array(["jjjj"], pa.large_string()))  # letters that no language has
    assert tie[0][0] in models.languages and 0 <= tie[1][0] <= 1


def test_packing_agrees_with_a_fresh_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert fresh.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [3306, 49407, 1002]
    rnd = random.Random(3)
    pieces = ["hello", "World.", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "é", "Été,", "İstanbul", "straße", "日本", "don't", "1234", " ", "\t", "\n", "...", "\U0001f600", "ﬁ", "ẍ"]
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b", "", None, "word " * 30_000, *("".join(rnd.choice(pieces) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randrange(1, 40))) for _ in range(200))]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "null id", 1, "x")], "doc_id long, text string, bucket int, ids string")
    found = defaultdict(list)
    for r in packing.pack_power_of_two(frame).collect():
        found[r["doc_id"]].append(r)
    for i, t in [*enumerate(texts), (None, "null id")]:
        ids = [*fresh.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(found[i], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own) == np.array(ids, np.uint32).tobytes(), texts[i] if i is not None else t
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own[:-1])]).tolist() and {r["doc_tokens"] for r in own} == {len(ids)}


def test_line_dedup_keeps_all_columns(spark):
    names = ["page_id", "html", "_host", "_kept", "_drop", "_row", "_text", "n_lines", "c0", "none"]
    rows = [(i, f"menu\nown {i}", *[f"{n}{i}" for n in names[2:]]) for i in range(6)]
    frame = spark.createDataFrame(rows, names)
    host = F.when(F.col("page_id") < 3, F.lit(None).cast("string")).otherwise("")
    for most in (1 << 20, 0):
        got = line_dedup.drop_boilerplate(frame, "html", host, broadcast_bytes=most)
        assert got.columns == [*(n for n in names if n != "n_lines"), "n_lines", "n_removed"]
        for r in got.collect():
            i = r["page_id"]
            assert r["html"] == f"own {i}" and all(r[n] == f"{n}{i}" for n in names[2:] if n != "n_lines") and (r["n_lines"], r["n_removed"]) == (2, 1)


def test_line_dedup_hosts_ratio_repeats_and_empty_tables(spark, none):
    rows = [(i, "x") for i in range(3)] + [(i, "x\ny") for i in range(3, 10)]
    frame = spark.createDataFrame([(i, t, None if i % 2 else "") for i, t in rows], "page_id long, html string, host string")
    apart = line_dedup.drop_boilerplate(frame, "html", F.col("host"), min_pages=5, ratio=0.9).collect()
    assert {r["html"] for r in apart} == {"", "y"}  # x is on 5 of 5 pages of both hosts
    merged = line_dedup.drop_boilerplate(frame, "html", F.col("host"), min_pages=6, ratio=0.5).collect()
    assert {r["html"] for r in merged} == {"x", "x\ny"}  # but on 6 of none
    at = spark.createDataFrame([(i, "z" if i < 5 else "q") for i in range(10)], "page_id long, html string")
    assert {r["html"] for r in line_dedup.drop_boilerplate(at, "html", F.lit("h"), ratio=0.5).collect()} == {"z", "q"}  # exactly at the ratio
    same = spark.createDataFrame([(1, "a\na\na\nb")] * 4, "page_id long, html string")
    assert [r["n_lines"] for r in line_dedup.drop_boilerplate(same, "html", F.lit("h")).collect()] == [4] * 4
    assert line_dedup.drop_boilerplate(none, "text", F.col("source")).count() == 0
    long = spark.createDataFrame([(i, "line\n" * 50_000 + str(i)) for i in range(4)], "page_id long, html string")
    assert {(r["html"], r["n_removed"]) for r in line_dedup.drop_boilerplate(long, "html", F.lit("h")).collect()} == {(str(i), 50_000) for i in range(4)}


def test_media_columns_agree_with_the_file(spark):
    rows = [(1, "one", 3), (2, "long " * 40_000, 4), (3, None, 5), (None, "null id", 6)]
    media = matroska.with_media(spark.createDataFrame(rows, "doc_id long, text string, media long")).cache()
    files = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    for r in matroska.media_features(media).collect():
        data = files[r["doc_id"]]
        text = next((t or "").encode() for i, t, _ in rows if i == r["doc_id"])
        payload = text + bytes(-len(text) % 64 if text else 64)
        assert (r["media_bytes"], r["media_sha256"], r["payload_bytes"], r["error"]) == (len(data), hashlib.sha256(data).hexdigest(), len(payload), None)
        x = [b - 128 for b in payload]
        crossed = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False))
        assert r["feature"].startswith(f"mean={sum(x) / len(x):.6f};rms={math.sqrt(sum(v * v for v in x) / len(x)):.6f};crossings={crossed};packets={-(-len(payload) // 512)};")
    bad = media.limit(1).selectExpr("doc_id", "n_bytes", "cast('nothing' as binary) media").unionByName(media.limit(1).selectExpr("doc_id", "n_bytes", "cast(null as binary) media"))
    got = matroska.media_features(bad).collect()
    assert all(r["error"] and r["payload_sha256"] is None and r["feature"] is None for r in got) and sorted(r["media_bytes"] is None for r in got) == [False, True]
    assert all(r["error"] and r["packet"] is None for r in matroska.packet_table(bad).collect())
    packets = matroska.packet_table(media.filter("doc_id = 2")).orderBy("packet").collect()
    assert b"".join(files[2][r["offset"] : r["offset"] + r["size"]] for r in packets) == (("long " * 40_000).encode()) and [r["timestamp_ns"] for r in packets[:3]] == [0, 64_000_000, 128_000_000]
    assert sum(r["in_cues"] for r in packets) == -(-200_000 // (512 * 64))


def test_two_writers_commit_one_version(spark, tmp_path):
    one, two = (sharding.ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    rows = spark.range(10).withColumn("manifest", F.lit("clash"))
    one.append(rows)
    base, schema = two.manifest(), rows.schema.json()
    mine = two.write(rows.filter("id < 3"))  # written, not committed
    one.append(rows.filter("id > 7"))
    with pytest.raises(sharding.Conflict):
        two.commit(base, base["shards"] + mine, schema)
    assert one.version() == 2 and two.read().count() == 12
    assert one.vacuum() == 0  # the lease spares what the other writer hasn't committed yet
    now = two.manifest()
    two.commit(now, now["shards"] + mine, schema)
    assert one.read().count() == 15 and not [f for f in (tmp_path / "s" / "manifests").iterdir() if not f.name.startswith((".v", "v"))]


def test_readers_keep_their_version_during_vacuum(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", small_bytes=1 << 20, target_bytes=4 << 20, fan_in=2)
    for k in range(4):
        store.append(spark.range(k * 10, k * 10 + 10).coalesce(1))
    reader = store.read(4)
    store.compact()
    assert store.vacuum(versions=2, lease=0.0) > 0
    assert reader.count() == 40 and store.read().count() == 40  # version 4 is one of the last two
    assert store.versions() == [4, 5]


def test_a_tier_that_cannot_shrink_does_not_stop_the_next(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", fan_in=2)
    for k in range(4):
        store.append(spark.range(k * 10, k * 10 + 10).coalesce(1))
    now = store.manifest()
    shards = sorted(now["shards"], key=lambda s: s["path"])
    for s, (size, tier) in zip(shards, ((store.target - 1, 0), (store.target - 1, 0), (store.target // 4, 3), (store.target // 4, 3)), strict=True):
        s["bytes"], s["tier"] = size, tier
    store.commit(now, shards, now["schema"])
    store.compact()
    assert len(store.manifest()["shards"]) == 3 and store.read().count() == 40


def test_sharding_of_empty_and_odd_tables(spark, none):
    store = sharding.ingest(spark, none, "doc_id")
    assert store.read().count() == 0 and store.read().schema == none.schema
    odd = spark.createDataFrame([(1, "x" * 300_000, None, "s", 1), (1, None, "a", None, 2), (1, None, "a", None, 2), (None, "", "b", "s", None)], SCHEMA)
    assert sorted(map(str, sharding.ingest(spark, odd, "doc_id").read().collect())) == sorted(map(str, odd.collect()))


def test_sharding_query_returns_every_document(spark):
    from textloom.session import table

    sf = "/root/testdata/sf0.001"
    got = sharding.op8_sharding(spark, sf).collect()
    want = {(r["doc_id"], len((r["text"] or "").encode()), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in table(spark, sf, "documents").collect() if r["text"] is not None}
    assert {(r["doc_id"], r["n_bytes"], r["text_sha256"]) for r in got if r["n_bytes"] is not None} == want


def recall(spark, x, **options):
    frame = spark.createDataFrame([(i, v.tolist(), 0, "clash") for i, v in enumerate(x)], "vec_id long, embedding array<float>, part int, leaf string")
    got = defaultdict(list)
    for r in vector_search.nearest(frame, every=20, **options).collect():
        got[r["query_id"]].append(r)
    y, hit = x.astype(float), 0
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        hit += len({r["vec_id"] for r in found} & set(np.argsort(-s, kind="stable")[:20].tolist()))
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
        assert [r["score"] for r in found] == pytest.approx([float(y[q] @ y[r["vec_id"]]) for r in found], rel=1e-12)
    assert len(got) == -(-len(x) // 20)
    return hit / (20 * len(got)), next(iter(got.values()))[0]["recall"]


def test_vector_search_recall_of_default_settings(spark):
    rng = np.random.default_rng(1)
    clustered = (rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] * 2 + rng.normal(size=(3000, 24))).astype(np.float32)
    for x in (rng.normal(size=(3000, 24)).astype(np.float32), clustered):
        found, measured = recall(spark, x)
        assert found >= 0.9 and measured >= 0.95


def test_vector_search_with_a_hot_leaf(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 8)).astype(np.float32)
    x[:600] = x[0] + rng.normal(size=(600, 8)).astype(np.float32) / 50
    assert recall(spark, x, part=64)[0] >= 0.9


def test_vector_search_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_search.nearest(empty, every=20).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0]), (21, [3.0, 1.0]), (22, [1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in vector_search.nearest(one, every=20).collect()] == [(20, 21, 5.0)]


def test_mixing_with_clashing_columns(spark):
    names = ["doc_id", "source", "text", "src", "h", "cls", "bucket", "i", "start", "step", "copies", "size", "target", "_0_src", "_copy"]
    rows = [(i, None if i % 7 == 0 else f"s{i % 3}", None if i == 5 else "word " * (i % 9), *[f"{n}{i}" for n in names[3:]]) for i in range(60)] + [(7, None, "again", *["x"] * 12)] * 2
    frame = spark.createDataFrame(rows, names)
    counts = Counter((r["doc_id"], r["size"], r["copies"]) for r in mixing.mix_counts(frame.select("doc_id", "source", "text")).collect())
    mixed = mixing.mix_documents(frame)
    assert mixed.columns == names
    got = Counter(tuple(r) for r in mixed.collect())
    assert set(got) <= set(rows) and sum(got.values()) == sum(c * n for (_, _, c), n in counts.items())


def test_every_stage_and_query_takes_an_empty_table(spark, none):
    import corpus_pipeline

    now = none
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0
    assert attention_lm.score_documents(none).count() == ngram_join.jaccard_classes(none).count() == suffix_dedup.digests(none).count() == packing.pieces(none).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on a small corpus, each stage recomputed plainly from what the one before it keeps."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = random.Random(11)
    kinds = {"aa": ["lorem", "ipsum", "dolor", "amet", "sit"], "bb": ["xyzzy", "qwop", "zork", "frob", "plugh"]}
    data = []
    for i in range(150):
        lang = ("aa", "bb")[i % 2]
        body = " ".join(rnd.choice(kinds[lang]) + rnd.choice(["", "", "s", "en"]) for _ in range(rnd.randrange(20, 60)))
        data.append([i, f"common {lang} line\n{body}", lang, f"s{i % 3}", 0])
    data[80][1], data[81][1] = data[10][1] + " end", data[10][1]
    data[100][1], data[101][1], data[102][1] = None, "12 34 !", "жщю яф " * 40
    for d in data:
        d[4] = len(d[1] or "")
    frame = spark.createDataFrame([tuple(d) for d in data], SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    models = language_id.fit(frame)
    rejected = models.predict(pa.array([d[1] or "" for d in data], pa.large_string()))[3]
    assert all(rejected[i] for i in (100, 101, 102)) and rejected.sum() < 8
    kept = [d for d, bad in zip(data, rejected, strict=True) if not bad]
    pages = Counter(d[3] for d in kept)
    on = Counter((d[3], line) for d in kept for line in set(d[1].split("\n")))
    clean = {d[0]: "\n".join(x for x in d[1].split("\n") if not (on[d[3], x] >= 3 and on[d[3], x] > 0.3 * pages[d[3]])) for d in kept}
    assert any(clean[d[0]] != d[1] for d in kept)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, t in clean.items() for w in [t.lower().split()]}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    firsts = [i for i, r in root.items() if r == i]
    assert 10 in firsts and 80 not in firsts and 81 not in firsts
    rest = spark.createDataFrame([(d[0], clean[d[0]], d[2], d[3], len(clean[d[0]])) for d in kept if d[0] in set(firsts)], SCHEMA)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_counts(rest).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, n in copies.items():
        ids, at = [*tokenizer.encode(clean[i], add_special_tokens=False).ids, 1], 0
        for size in packing.binary_lengths(len(ids)):
            want[i, at, size, zlib.crc32(np.array(ids[at : at + size], np.uint32).tobytes()), len(ids)] += n
            at += size
    got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want


def test_words_of_very_long_and_odd_texts(spark):
    """One text of a megabyte, null ids and repeated rows go through every operator on texts."""
    rows = [(1, "long word " * 100_000, "en", "s", 1), (2, "long word " * 100_000 + "x", "en", "s", 1), (None, "null id", None, None, None), (3, None, None, None, None), (3, None, None, None, None), (4, "tie", "en", "s", 1), (5, "tie", "en", "s", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    scored = attention_lm.score_documents(frame).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in scored) == [(0, 3), (1, 200_001), (2, 200_002), (3, 1), (3, 1), (4, 2), (5, 2)]
    classes = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_classes(frame).collect()}
    assert classes == {(1, 1), (2, 2), (None, None), (3, 3), (4, 4), (5, 4)}
    assert re.match(r"^[0-9a-f]{64}$", suffix_dedup.digests(frame.filter("doc_id > 3")).first()["kept_sha256"])


def test_language_sample_has_every_language_within_its_bounds(spark):
    xx = [(i, f"wort wert wirt {i} " * 20, "xx", None, None) for i in range(300)]
    zz = [(10_000 + i, "zuzu zaza zozo " * 200_000, "zz", None, None) for i in range(3)]
    docs = spark.createDataFrame(xx + zz, SCHEMA)
    found = language_id.sample(docs)
    assert [x[0] for x in found] == ["xx", "zz"] and all(x[1] for x in found)
    models = language_id.fit(docs)
    assert models.languages == ["xx", "zz"] and models.predict(pa.array(["zaza zuzu zozo", "wirt wort"], pa.large_string()))[0] == ["zz", "xx"]
    one = "lorem ipsum dolor " * 55_000
    many = spark.createDataFrame([(i, one, "la", None, None) for i in range(40)] + [(77, "und so weiter", "de", None, None)] * 5000, SCHEMA)
    found = {x[0]: x[1:] for x in language_id.sample(many, characters=4_000_000)}
    for fit, calibrate in found.values():
        assert fit and sum(map(len, fit)) <= 4_000_000 and len(fit) <= language_id.PER_LANGUAGE
        assert len(calibrate) <= max(language_id.DRAWN, len(fit)) and sum(map(len, calibrate)) <= 4_000_000


def test_vector_sample_is_bounded_where_one_id_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").unionByName(spark.range(60_000).selectExpr("1000 vec_id", "array(0.1D, 0.2D, 0.3D, 0.4D) embedding"))
    tree, _, recall, n = vector_search.prepare(vector_search.usable(df), 20, 5, 100, 50, 0.9)
    assert n == 60_200 and recall >= 0.9 and tree.leaves <= 200


def test_pipeline_stages_keep_a_users_columns(spark):
    import corpus_pipeline

    rows = [(i, f"the people of the town say that it is a good day {i}\nsame line here", "en", f"s{i % 2}", 9, f"own {i}", "mine", 7) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang_pred string, rejected string, n_lines int")
    for stage in (corpus_pipeline.detect_language, corpus_pipeline.drop_lines):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {tuple(r) for r in out.select("doc_id", "lang_pred", "rejected", "n_lines").collect()} <= {(r[0], *r[5:]) for r in rows}
    assert out.count() == 40
