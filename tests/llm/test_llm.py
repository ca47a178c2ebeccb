"""The operators on small tables: brute force, round trips, and the odd cases (nulls, empties, ties, repeats, extra columns)."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import attention_lm, language_id, line_dedup, matroska, mixing, ngram_join, packing, sharding, suffix_dedup, vector_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long"
WORDS = ["the", "of", "and", "er", "Én", "straße", "thing", "re", "a.", "x,"]
PASSAGE = "this passage of more than fifty bytes stands in several of the documents "


def rows():
    rnd = random.Random(4)
    out = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 60))) + (PASSAGE if i % 4 == 0 else ""), "en", f"s{i % 3}", 1, 9) for i in range(24)]
    near = " ".join(f"w{i}" for i in range(120))
    out += [(30, near, "fr", "s1", 1, 1), (31, near + " w120", "fr", None, 1, 1), (32, near, "fr", "s1", 1, 1), (33, near.replace("w60", "q"), "fr", "s1", 1, 1)]
    return out + [(40, None, None, None, None, None), (41, "", None, "s0", 0, 0), (42, " \n", None, "s0", 0, 0), (43, "12 34", "en", "s0", 0, 0), (43, "12 34", "en", "s0", 0, 0), (44, "long " * 5000, "en", "s2", 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_jaccard_classes(docs, none):
    for similar, shingle in (((90, 100), 3), ((80, 100), 5)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(docs, similar, shingle).collect()}
        sets = {}
        for i, t, *_ in rows():
            w = [x.lower() for x in words(t)]
            sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
        root = {i: i for i in sets}
        for _ in sets:
            for i, a in sets.items():
                for j, b in sets.items():
                    if a and b and 100 * len(a & b) >= similar[0] * len(a | b):
                        root[i] = root[j] = min(root[i], root[j])
        assert got == {i: (len(s), root[i]) for i, s in sets.items()}
    assert ngram_join.jaccard_classes(none).count() == 0


def test_jaccard_classes_over_many_blocks(spark):
    """Chains of near copies, repeated ids and clashing columns, with blocks so small that groups take many."""
    rnd = random.Random(6)
    texts, now = [], [f"w{i}" for i in range(60)]
    for i in range(120):
        if i % 40 == 0:
            now = [f"v{i}x{k}" for k in range(60)]
        now = now[:]
        now[rnd.randrange(60)] = f"n{i}"
        texts.append((i, " ".join(now)))
    texts += [(200, texts[5][1]), (200, texts[50][1]), (201, "one two three"), (201, "four five six"), (202, "four five six"), (203, "one two")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, node long, grp long")
    for similar, shingle in (((90, 100), 3), ((80, 100), 5)):
        sets = [(i, {tuple(t.split()[k : k + shingle]) for k in range(len(t.split()) - shingle + 1)} or {tuple(t.split())}) for i, t in texts]
        root = {i: i for i, _ in texts}
        for i, a in sets:
            for j, b in sets:
                if 100 * len(a & b) >= similar[0] * len(a | b) and root[i] != root[j]:
                    low, high = sorted((root[i], root[j]))
                    root = {k: low if r == high else r for k, r in root.items()}
        for block in (2048, 7):
            got = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_classes(frame, similar, shingle, block_sets=block).collect()}
            assert got == set(root.items())


def test_keys_miss_no_link():
    rng = np.random.default_rng(1)
    for similar in ((90, 100), (80, 100)):
        for _ in range(60):
            n = int(rng.integers(1, 120))
            base = rng.integers(0, 2**63, n).astype(np.uint64)
            sets = [np.unique(np.concatenate([base[rng.permutation(n)[: n - int(rng.integers(0, n // 6 + 1))]], rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 1))).astype(np.uint64)])) for _ in range(5)]
            keys, roles, of = ngram_join.set_keys(sets, similar)
            met = {}
            for k, r, i in zip(keys.tolist(), roles.tolist(), of.tolist(), strict=True):
                met.setdefault(k, []).append((i, r))
            for i in range(5):
                for j in range(i):
                    inter = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * inter >= similar[0] * (len(sets[i]) + len(sets[j]) - inter):
                        assert any({i, j} <= {x for x, _ in m} for m in met.values())


def test_prefix_keys_miss_no_link_in_any_order():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 200, 1 << ngram_join.CELL_BITS).astype(np.uint8)
    for _ in range(80):
        n = int(rng.integers(8, 300))
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[rng.permutation(n)[: n - int(rng.integers(0, n // 6 + 1))]], rng.integers(0, 2**64, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)])) for _ in range(4)]
        keys, roles, of = ngram_join.set_keys(sets, (80, 100), common)
        node, first, role = ngram_join.tied(keys, of, roles)
        root = list(range(len(sets)))
        for a, b in zip(node.tolist(), first.tolist(), strict=True):
            root = [root[b] if r == root[a] else r for r in root]
        for i in range(len(sets)):
            for j in range(i):
                inter = len(np.intersect1d(sets[i], sets[j]))
                if 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                    assert root[i] == root[j]


def test_commonness(docs):
    table = ngram_join.commonness(docs, 5000, 5)
    assert len(table) == 1 << ngram_join.CELL_BITS
    met = {}
    for text in {t for _, t, *_ in rows()}:
        for h in ngram_join.shingle_sets(pa.array([text or ""], pa.large_string()), 5)[0].tolist():
            met[h] = met.get(h, 0) + 1
    for h, n in met.items():
        assert table[h >> 64 - ngram_join.CELL_BITS] >= (int(8 * np.log2(n)) if n > 1 else 0)


def removed_by_brute_force(texts):
    want = []
    for i, b in texts:
        earlier = {x[p : p + 50] for j, x in texts if j < i for p in range(len(x) - 49)}
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if b[p : p + 50] in earlier:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(want)


def odd_texts():
    """Periods, very long texts, common passages in changing surroundings, repeated ids."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcde ") for _ in range(rnd.randrange(1, 30)))
    out = [(i, word() + PASSAGE * (i % 2) + word() + ("ab" * 90 if i % 5 == 0 else "") + word()) for i in range(60)]
    return out + [(70, "xyz" * 9000), (71, "q" + "xyz" * 4000), (71, "zzz" + PASSAGE * 2), (72, "a" * 20_000), (73, "b" + "a" * 300), (74, PASSAGE[:49]), (75, None), (76, ""), (3, PASSAGE + "again")]


def test_suffix_dedup(spark, docs, none, monkeypatch):
    for texts in ([(i, t) for i, t, *_ in rows()], odd_texts()):
        frame = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, h long, stretch string")
        want = removed_by_brute_force([(i, (t or "").encode()) for i, t in texts])
        for hot, cut in (((1000, 1_000_000), 4096), ((3, 3), 40)):  # the second: most anchors are hot, stretches are short
            monkeypatch.setattr(suffix_dedup, "HOT", hot)
            monkeypatch.setattr(suffix_dedup, "CUT", cut)
            assert sorted(tuple(r) for r in suffix_dedup.digests(frame).collect()) == want
        full = suffix_dedup.remove_repeats(frame).collect()
        assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in full) == want
        assert all(sum(x["end"] - x["start"] for x in r["spans"]) == r["n_removed"] for r in full)
    assert suffix_dedup.digests(none).count() == suffix_dedup.remove_repeats(none).count() == 0


def test_previous_smaller():
    values = np.array([3, 1, 2, 2, 0, 5, 4])
    common = np.array([0, 9, 9, 7, 9, 9, 5])
    assert [x.tolist() for x in suffix_dedup.previous_smaller(values, common, 1)] == [[-1, -1, 1, 1, -1, 4, 4], [0, 0, 9, 7, 0, 9, 5]]
    assert suffix_dedup.previous_smaller(values, common, 6)[0].tolist() == [-1, -1, 1, 1, -1, 4, -1]


def test_previous_factors_against_brute_force():
    rnd = random.Random(8)
    for length in (3, 8, 13):
        texts = [bytes(rnd.choice(b"ab\xff\0") for _ in range(rnd.randrange(length, 60))) for _ in range(30)] + [b"a" * 40, b"a" * 25, b"ab" * 20]
        documents = np.array([rnd.randrange(8) for _ in texts])
        factors, marks = suffix_dedup.previous_factors(texts, documents, length)
        order, common = suffix_dedup.suffix_order(np.frombuffer(b"".join(texts), np.uint8), np.arange(20), length)
        whole = b"".join(texts) + bytes(80)
        depth = -(-length // 8) * 8
        heads = [whole[p : p + depth] for p in order]
        assert heads == sorted(heads)
        assert common[1:].tolist() == [next((k for k in range(depth) if x[k] != y[k]), depth) for x, y in zip(heads[:-1], heads[1:], strict=True)]
        for i, t in enumerate(texts):
            for p in range(len(t) - length + 1):
                before = any(t[p : p + length] in u for u, d in zip(texts, documents, strict=True) if d < documents[i])
                assert (factors[marks[i] + p] >= length) == before


def test_matroska_round_trip():
    for payload in (b"\0" * 64, bytes(range(256)) * 300, b"x" * (64 * 77)):
        data = matroska.write(payload)
        found = matroska.read(data)
        assert matroska.samples(data, found) == payload and found["cues"][0][0] == 0
        assert all(t["codec"] == "A_PCM/INT/LIT" for t in found["tracks"])
    frames = [b"a" * 300, b"b" * 10, b"c" * 700, b"d" * 5]
    for kind in (1, 3):
        body = b"\x81\x00\x00" + bytes([kind << 1]) + matroska.lace([len(f) for f in frames], kind) + b"".join(frames)
        assert [body[o : o + n] for o, n in matroska.block(body, 0, len(body))[3]] == frames


def test_matroska_columns(docs, none):
    got = {r["doc_id"]: r for r in matroska.media_features(matroska.with_media(docs)).collect()}
    for i, t, *_ in rows():
        b = (t or "").encode()
        payload = b + bytes(-len(b) % 64 if b else 64)
        assert (got[i]["n_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(b), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[30]["media_sha256"] == got[32]["media_sha256"]
    assert matroska.media_features(matroska.with_media(none)).count() == 0
    bad = docs.limit(1).selectExpr("doc_id", "cast('nothing' as binary) media")
    assert matroska.packet_table(bad).first()["error"]


def test_packing(docs, none):
    tokenizer = packing.ChunkTokenizer(None).tokenizer
    got = packing.pack_power_of_two(docs).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0 for r in got)
    pieces = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["start"])):
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in rows():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], np.uint32).tobytes()
        assert b"".join(bytes(r["ids"]) for r in pieces[i]) == ids * (2 if i == 43 else 1)
    assert packing.pieces(none).count() == 0


def test_language_id(spark, docs, none):
    rng = random.Random(2)
    kinds = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["xyzzy", "qwop", "zork"]}
    known = [(i, " ".join(rng.choice(kinds[k]) for _ in range(20)), k, "s", 1, 1) for i in range(80) for k in [rng.choice(["aa", "bb"])]]
    frame = spark.createDataFrame(known, SCHEMA)
    models = language_id.fit(frame)
    got = language_id.identify(frame, models).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 and r["node"] == 1 for r in got)
    odd = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, models).collect()}
    assert odd[40] == odd[41] == odd[43] == "und"
    assert language_id.identify(none).count() == 0


def test_language_id_rejects_in_rare_languages(spark):
    rng = random.Random(3)
    kinds = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["xyzzy", "qwop", "zork"]}
    known = [(i, " ".join(rng.choice(kinds[k]) for _ in range(20)), k, "s", 1, 1) for i in range(60) for k in [("aa", "bb")[i % 2]]]
    for options in ({}, {"per_language": 12}):
        models = language_id.fit(spark.createDataFrame(known, SCHEMA), **options)
        assert np.isfinite(models.limits).all()
        rejected = models.predict(pa.array([known[0][1], known[1][1], "ж щ ю я ф " * 40], pa.large_string()))[3]
        assert rejected.tolist() == [False, False, True]


def test_mixing(docs, none):
    got = mixing.mix_counts(docs).collect()
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        assert r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
    assert {r["source"]: r["source_size"] for r in got} == dict(sizes)
    targets = {r["source"]: r["target"] for r in got}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(t <= 2 * sizes[s] + 1e-9 for s, t in targets.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_counts(docs).collect()))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix_counts(none).count() == 0


def test_line_dedup(spark):
    pages = [(i, f"http://h/{i}", f"menu\nown {i}\n\n" + ("rare" if i < 2 else "")) for i in range(10)] + [(90, None, None), (91, "http://one/", "menu\nx")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for most in (1 << 20, 0):
        got = {r["page_id"]: r for r in line_dedup.drop_boilerplate(frame, "html", line_dedup.host_of(frame["url"]), broadcast_bytes=most).collect()}
        assert got[0]["html"] == "own 0\n\nrare" and got[0]["n_removed"] == 1 and got[0]["n_lines"] == 3
        assert got[90]["html"] is None and got[91]["html"] == "menu\nx"


def test_vector_search_finds_all_when_all_leaves_are_visited(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    x[50:90] = x[0]
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] + [1.0] * 7, 1)]
    got = vector_search.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"), every=20, target=1.0, part=16).collect()
    y = x.astype(float)
    for q in range(0, 200, 20):
        s = (y * y[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(200), -s)) if i != q][:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[1] for m in mine] == order and [m[2] for m in mine] == s[order].tolist()
    assert len(got) == 200


def test_attention_lm(docs, none):
    got = attention_lm.score_documents(docs).collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows()}
    low = lambda t: [*(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)), None]
    counts = Counter(w for i, t, *_ in rows() if not held[i] for w in low(t))
    n, v = sum(counts.values()), len(counts)
    texts = {i: t for i, t, *_ in rows()}
    for r in got:
        tokens = low(texts[r["doc_id"]])
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(base) and np.isfinite(r["score"]) and r["score"] < 0
    assert attention_lm.score_documents(none).count() == 0


def test_attention_lm_without_training_documents_scores_as_the_base(docs):
    only = docs.filter(attention_lm.held_out(docs.doc_id))
    assert only.count() and all(r["score"] == r["base_score"] and r["train_tokens"] == 0 for r in attention_lm.score_documents(only).collect())


def small_model(texts, taught):
    """A vocabulary and a model with random parameters, and the words of ``texts`` as a slice has them."""
    distinct, codes, bounds = attention_lm.words(pa.array(texts, pa.large_string()))
    ids, sizes = attention_lm.subwords().ids(distinct)
    times = np.bincount(codes[np.repeat(taught, np.diff(bounds))], minlength=len(sizes))
    v = attention_lm.Vocabulary(np.bincount(ids, np.repeat(times, sizes), attention_lm.IDS).astype(np.int64), np.bincount(attention_lm.first_ids(ids, sizes)[times > 0], minlength=attention_lm.IDS))
    x, weight, _ = attention_lm.stream(bounds, codes, ids, sizes, v.unit, np.flatnonzero(taught))
    pairs = np.zeros((attention_lm.SIZE, attention_lm.SIZE), np.int64)
    np.add.at(pairs, (x[weight], np.append(x[1:], attention_lm.EDGE)[weight]), 1)
    return v.fit(pairs), (bounds, codes, ids, sizes, times), pairs


def test_attention_scores_agree_with_a_loop_over_ids():
    """Each id is predicted once, from its window, and a word's rest is the stated mixture."""
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice([*WORDS, "unbelievably", "straßenbahn", "x1y2"]) for _ in range(n)) for n in (0, 1, 5, 40, 90)] + ["neverseen wörds"]
    v, (bounds, codes, ids, sizes, times), _ = small_model(texts, np.array([True] * 5 + [False]))
    model, rng, s = attention_lm.Attention(v), np.random.default_rng(5), attention_lm.STRIDE
    model.p["near"] = rng.normal(size=2 * s).astype(np.float32)
    got = attention_lm.text_scores(model, v, bounds, codes, ids, sizes, times)
    p = {k: x.astype(float) for k, x in model.p.items()}
    starts = np.cumsum(sizes) - sizes

    def probabilities(seen, last):
        """Of all units, given the places that the window has: those of its own stride up to ``last`` and of the stride before."""
        low = (last // s) * s - s
        places = [seen[q] if q >= 0 else attention_lm.EDGE for q in range(low, last + 1)]
        emb = p["emb"][places]
        weight = np.exp(emb @ p["k"] @ (emb[-1] @ p["q"] * attention_lm.WIDTH**-0.5) + p["near"][np.arange(len(places))[::-1]])
        logits = weight @ (emb @ p["v"]) / weight.sum() @ p["out"] + v.class_log[places[-1]]
        classes = np.exp(logits) / np.exp(logits).sum()
        units = classes[v.kind] * np.exp(v.unit_log[places[-1]].astype(float))
        assert units.sum() == pytest.approx(1, abs=1e-4)
        return units, classes[v.ended :].sum()

    for i in range(len(texts)):
        seen, total = [attention_lm.EDGE], 0.0
        for w in codes[bounds[i] : bounds[i + 1]]:
            own = ids[starts[w] : starts[w] + sizes[w]]
            units, ended = probabilities(seen, len(seen) - 1)
            assert np.isclose(ended, units[v.begins].sum(), atol=1e-4)
            total += np.log(units[v.unit[own[0]]] / ended) + v.within[own[0]]
            seen.append(int(v.unit[own[0]]))
            rest = 1.0
            for x in own[1:]:
                units, _ = probabilities(seen, len(seen) - 1)
                rest *= units[v.unit[x]] * np.exp(v.within[x])
                seen.append(int(v.unit[x]))
            rest *= probabilities(seen, len(seen) - 1)[1]
            n, t = v.times[own[0]], v.types[own[0]]
            known = n / max(1, n + t)
            total += np.log(known * times[w] / max(1, n) + (1 - known) * rest)
        units, ended = probabilities(seen, len(seen) - 1)
        total += np.log(units[attention_lm.EDGE] / ended)
        assert got[i] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_subwords_of_odd_words():
    odd = ["a\u00a0b", "\u3000", "x\u2003", "'s", "don't", "12ab", "...", "é" * 40, "日本語", "\x1c", "plain"]
    encode = attention_lm.subwords()
    ids, sizes = encode.ids(pa.array(odd, pa.large_string()))
    assert encode.encoding.decode(ids.tolist()) == "".join(" " + w for w in odd)
    plain = [w for w in odd if not re.search("[\u00a0\u3000\u2003]", w)]
    found, many = encode.ids(pa.array(plain, pa.large_string()))
    assert [x.tolist() for x in np.split(found, np.cumsum(many)[:-1])] == [encode.encode(" " + w).tolist() for w in plain]


def test_attention_counts_and_trains_on_every_training_document(spark, docs, monkeypatch):
    own = docs.select("doc_id", "text", attention_lm.held_out(docs.doc_id).alias("held")).fillna("", "text").coalesce(3)
    sliced = attention_lm.slice_rows(own)
    texts = [(i, t or "") for i, t, *_ in rows()]
    v, (bounds, codes, ids, sizes, times), pairs = small_model([t for _, t in texts], np.array([zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in texts]))
    counts = attention_lm.id_counts(sliced)
    assert counts.tolist() == v.times.tolist() and (attention_lm.pair_counts(sliced, v.unit) == pairs).all()
    rounds = attention_lm.round_of([i for i, _ in texts], 2)
    assert set(rounds) == {0, 1}
    given = spark.sparkContext.broadcast(v)
    for number in range(2):
        model = attention_lm.Attention(v)
        start = model.p["out"].copy()
        after = attention_lm.train(attention_lm.slice_rows(own.coalesce(1)), given, model, number)
        learner = attention_lm.Learner(attention_lm.Attention(v), v)
        chosen = np.flatnonzero([zlib.crc32(str(i).encode()) % 7 != 2 and r == number for (i, _), r in zip(texts, rounds, strict=True)])
        learner.learn(*attention_lm.stream(bounds, codes, ids, sizes, v.unit, chosen)[:2], number)
        n = np.diff(bounds)[chosen].sum()
        assert n and learner.seen == sum(int(sizes[codes[bounds[i] : bounds[i + 1]]].sum()) + 1 for i in chosen)
        assert not np.allclose(after.p["out"], start)
    monkeypatch.setattr(attention_lm, "FAN", 2)  # sums by levels
    assert attention_lm.id_counts(sliced).tolist() == counts.tolist()


def test_attention_beats_the_base_on_held_out_documents(spark):
    rnd = random.Random(9)
    kinds = [["the", "of", "and", "thing", "there"], ["der", "die", "straße", "und", "nicht"], ["que", "de", "ción", "los", "para"]]
    data = [(i, " ".join(rnd.choice(kinds[i % 3]) for _ in range(rnd.randrange(5, 80)))) for i in range(400)]
    got = attention_lm.score_documents(spark.createDataFrame(data, "doc_id long, text string")).filter("held_out").collect()
    assert len(got) > 30 and sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 0.1 * sum(r["n_tokens"] for r in got)


def test_attention_gradient():
    v, _, _ = small_model(["the of thing and er"] * 4, np.ones(4, bool))
    model, rng = attention_lm.Attention(v), np.random.default_rng(0)
    emb = rng.normal(size=(9, attention_lm.WIDTH)).astype(np.float32)
    x = rng.integers(0, 9, (2, 3 * attention_lm.STRIDE)).astype(np.int16)
    n = 2 * 2 * attention_lm.STRIDE
    target, weight, class_log = rng.integers(0, attention_lm.CLASSES, n), rng.random(n) < 0.7, rng.normal(size=(9, attention_lm.CLASSES)).astype(np.float32)
    loss = lambda: -model.log_probability(*model.tables(emb), x, target, class_log)[0].astype(float)[weight].mean()
    g = model.gradient(emb, x, target, weight, class_log)
    for name, p in [*((k, model.p[k]) for k in ("q", "k", "v", "near", "out")), ("emb", emb)]:
        i = np.unravel_index(np.abs(g[name]).argmax(), p.shape)
        step, before = np.float32(0.02), p[i]
        p[i] = before + step
        up = loss()
        p[i] = before - step
        down = loss()
        p[i] = before
        assert (up - down) / (2 * float(step)) == pytest.approx(float(g[name][i]), rel=0.1, abs=1e-4)


def test_attention_gradient_is_summed_over_runs_taken_together(monkeypatch):
    """The sum doesn't depend on how many runs are held at a time, which bound what a step holds."""
    import tracemalloc

    v, _, _ = small_model(["the of thing and er"] * 4, np.ones(4, bool))
    model, rng, runs, s = attention_lm.Attention(v), np.random.default_rng(0), attention_lm.BATCH, attention_lm.STRIDE
    model.p["near"] = rng.normal(size=2 * s).astype(np.float32)
    x = rng.integers(0, 9, (runs, (attention_lm.RUN + 1) * s)).astype(np.int16)
    n = runs * attention_lm.RUN * s
    given = rng.normal(size=(9, attention_lm.WIDTH)).astype(np.float32), x, rng.integers(0, attention_lm.CLASSES, n), rng.random(n) < 0.7, rng.normal(size=(9, attention_lm.CLASSES)).astype(np.float32)

    def found(together):
        monkeypatch.setattr(attention_lm, "TOGETHER", together)
        tracemalloc.start()
        g = model.gradient(*given)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return g, peak

    whole, most = found(runs)
    for together in (16, 7, 1):
        part, peak = found(together)
        assert peak < most / 2 and all(np.allclose(part[k], whole[k], rtol=1e-3, atol=1e-5) for k in model.p)


def test_shard_store(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", small_bytes=1, target_bytes=1 << 20, fan_in=2)
    for k in range(4):
        store.append(docs.filter(f"pmod(doc_id, 4) = {k}").coalesce(1))
        store.compact()
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    assert store.read(1).count() == docs.filter("pmod(doc_id, 4) = 0").count()
    base = store.manifest(1)
    with pytest.raises(sharding.Conflict):
        store.commit(base, [], base["schema"])
    store.vacuum()
    assert store.read().count() == docs.count()


def test_pipeline_keeps_columns_and_takes_effect(spark, docs):
    import corpus_pipeline

    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        after = stage(spark, now, "")
        assert after.columns == now.columns
        if name == "ngram_join":
            assert after.filter("doc_id in (31, 32, 33)").count() == 0
        now = after
