"""The ten operators against plain versions of themselves, on small tables with nulls, empty texts, ties and repeats."""

import gzip
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodemark.llm import decontamination, langid, linededup, packing, quality, quantisation, sharding, simhash, toxicity, warc
from lodemark.llm.common import components

DOCS = "doc_id long, text string, k string"
WORDS = [a + b for a in ("ba", "ko", "ri", "ten", "lu", "mor") for b in ("da", "fi", "go", "sel", "nu")]


def text(seed, n=60):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(30)) for _ in range(n))


def table(spark):
    rows = [(i, text(i, 5 + 20 * i), "x") for i in range(12)]
    rows += [(20, text(3, 65), "x"), (21, text(3, 65), "x"), (22, None, "x"), (23, "", "x"), (24, " \n\t", None), (None, "lone words here", "x"), (25, text(9, 3000), "x"), (25, text(9, 3000), "x"), (26, "a" * 5000, "x"), (27, "a <|endoftext|> b<|endoftext|>", "x")]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_fingerprint_by_hand():
    words = "The cat Sat on the mat".lower().split()
    ones = [0] * 64
    for i in range(4):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42)
        ones = [o + (h >> b & 1) for b, o in enumerate(ones)]
    assert simhash.fingerprint("The cat  Sat\non the mat") == sum(1 << b for b, o in enumerate(ones) if o * 2 > 4)
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0
    assert simhash.fingerprint("Two words") == xxhash.xxh64_intdigest("two words", 42)


def test_simhash_links(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 64, 40, dtype=np.uint64)
    near = np.concatenate([base] + [base ^ np.uint64(1 << int(draw.integers(64))) ^ np.uint64(1 << int(draw.integers(64))) for _ in range(6)])
    fps = np.unique(near)
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), 2, tile=8)
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    label = {int(x): int(x) for x in fps.view(np.int64)}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, x in enumerate(fps):
        for j in np.nonzero(np.bitwise_count(fps ^ x) <= 2)[0]:
            a, b = find(int(fps[i].view(np.int64))), find(int(fps[j].view(np.int64)))
            label[max(a, b)] = min(a, b)
    assert {x: root.get(x, x) for x in label} == {x: find(x) for x in label}


def test_simhash_groups(spark):
    got = simhash.near_duplicates(table(spark)).collect()
    of = {r["doc_id"]: r for r in got}
    assert len(got) == table(spark).count()
    assert of[20]["component_id"] == of[21]["component_id"] == 3
    assert of[22]["fingerprint"] == "0" * 16 and of[23]["component_id"] == of[24]["component_id"] == 22
    assert simhash.near_duplicates(empty(spark)).count() == 0
    clashing = table(spark).withColumns({c: F.concat(F.lit("keep "), F.lit(c)) for c in ("d", "null", "h", "_h", "fp")})
    kept = simhash.keep_one(clashing).collect()
    assert {r["doc_id"] for r in kept}.isdisjoint({20, 21, 23, 24}) and {r[c] for r in kept for c in ("d", "null", "h", "_h", "fp")} == {f"keep {c}" for c in ("d", "null", "h", "_h", "fp")}
    assert simhash.keep_one(empty(spark)).count() == 0


def shingles_of(t, n=5):
    w = t.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_similar_groups_against_brute_force(spark):
    draw, texts = random.Random(11), []
    for b in range(40):
        base = text(7000 + b, draw.randrange(60, 400)).split()
        for share in (0, 0, 0.002, 0.005, 0.02, 0.1):
            texts.append(" ".join("changed" + str(draw.random()) if draw.random() < share else w for w in base))
    texts += ["", " ", "one two", "one two", "one two three"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    for tile in (32_768, 16):
        got = {r["doc_id"]: r for r in simhash._similar(docs, 0.8, 5, 8, "doc_id", "text").collect()} if tile > 16 else None
        if tile == 16:
            # the same links from tiles that a size has many of
            rows = spark.createDataFrame([(i, bytearray(fps[i][0].to_bytes(4, "big") + fps[i][1].tobytes())) for i in range(len(texts))], "node long, fp binary").dropDuplicates(["fp"])
            root = {r["node"]: r["root"] for r in components(simhash.similar_links(rows, tile=16)).collect()}
            firsts = {r["node"]: root.get(r["node"], r["node"]) for r in rows.collect()}
            assert len(set(firsts.values())) == len({r["component_id"] for r in got_first.values()})
            continue
        fps = [simhash.wide_fingerprint(t) for t in texts]
        label, got_first = list(range(len(texts))), got
        sets = [shingles_of(t) for t in texts]
        for i, (n, x) in enumerate(fps):
            assert n == len(sets[i])
            for j in range(i):
                m, y = fps[j]
                differ = int(np.bitwise_count(x ^ y).sum())
                jaccard = len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0
                near = n == m and differ == 0 or min(m, n) >= 0.8 * max(m, n) and np.bitwise_count(x[0] ^ y[0]) <= 24 and differ <= simhash.allowed_bits(np.array([n]), np.array([m]), 0.8, 512)[0]
                assert near or jaccard < 0.87
                assert not near or jaccard > 0.6
                if near:
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if v == old else v for v in label]
        assert [got[i]["component_id"] for i in range(len(texts))] == label
    assert {r["doc_id"]: r["shingles"] for r in simhash.similar_groups(docs.where("doc_id >= 240")).collect()} == {240: 0, 241: 0, 242: 1, 243: 1, 244: 1}


def test_hypergeometric():
    draw = np.random.default_rng(3)
    for good, bad, n in ((5, 7, 6), (300, 9000, 50), (1, 1, 1), (0, 4, 2), (4, 0, 2), (40, 3, 39)):
        mine = np.array([sharding.hypergeometric(draw, good, bad, n) for _ in range(20_000)])
        his = draw.hypergeometric(good, bad, n, 20_000)
        spread = max(his.std(), 1e-9)
        assert abs(mine.mean() - his.mean()) <= 5 * spread / 100 and abs(mine.std() - his.std()) <= 0.05 * spread + 1e-9 and mine.min() >= max(0, n - bad) and mine.max() <= min(n, good)
    # on both sides of a population of 10^9: draws of few are as good as binomial ones
    for total in (9 * 10**8, 4 * 10**12):
        mine = np.array([sharding.hypergeometric(draw, total // 4, total - total // 4, 40) for _ in range(20_000)])
        mass = np.bincount(draw.binomial(40, 0.25, 200_000), minlength=41) / 200_000
        seen = np.bincount(mine, minlength=41) / 20_000
        assert np.abs(seen - mass).max() < 0.012


def test_shuffle_is_uniform(spark):
    """200 rows alike among 400: their number in a shard is hypergeometric, as is that of rows that lay side by side."""
    docs = spark.createDataFrame([(7, "same text") if i % 2 else (i, f"text {i}") for i in range(400)], "doc_id long, text string").repartition(3)
    chi = []
    for seed in range(6):
        got = sharding.shuffle_into_shards(docs, 4, seed=seed, bucket_rows=60).collect()
        counts = np.bincount([r["shard"] for r in got if r["doc_id"] == 7], minlength=4)
        chi.append(((counts - 50) ** 2 / 25).sum() * 3 / 4)
        first = sum(r["doc_id"] == 7 for r in got if r["slot"] < 50)
        assert 70 <= first <= 130
    # three degrees of freedom: a mean of 6 draws of 3, give or take 1
    assert 0.3 < np.mean(chi) < 7


def test_sharding(spark):
    got = sharding.shuffle_into_shards(table(spark).withColumns({"row": F.lit("x"), "p": F.lit("y")}), 4, bucket_rows=5).collect()
    sizes = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(4)]
    assert len(got) == 22 and all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (22, 23)} == {(8, 0)}
    assert sharding.shuffle_into_shards(empty(spark)).count() == 0
    m = sharding.communication_matrix([30, 0, 70, 7], 5, 1)
    assert m.sum(axis=1).tolist() == [30, 0, 70, 7] and sorted(m.sum(axis=0).tolist()) == [21, 21, 21, 22, 22]


@pytest.mark.parametrize("capacity", [1024, 16])
def test_packing(spark, capacity):
    path, docs = packing.vocabulary(), table(spark)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    want = sorted([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect())
    got = packing.pack(docs, path, capacity, waste=2).collect()
    assert sum(r["length"] for r in got) == sum(map(len, want))
    for r in got:
        assert 4 * r["length"] == len(r["ids"])
        if r["doc_id"] is not None and r["doc_id"] < 12:
            ids = [*tokenizer.encode(text(r["doc_id"], 5 + 20 * r["doc_id"]), add_special_tokens=False).ids, 0]
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids)
    filled: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= capacity and sum(filled.values()) >= 0.85 * capacity * (len(filled) - 1)
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got if r["doc_id"] == 27] == [[64, 220, 50256, 275, 50256, 0]] or capacity == 16
    digests = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in packing.with_digests(packing.pack(docs, path, capacity, waste=2)).collect()}
    assert digests == {(r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in got}
    assert packing.pack(empty(spark), path).count() == 0


def test_linear_program():
    patterns = packing.solve({600: 10, 400: 10, 24: 10}, 1024)
    assert abs(sum(u for u, _ in patterns) - 10) < 1e-6
    assert all(sum(k * n for k, n in p.items()) <= 1024 for _, p in patterns)


def test_patterns_place_what_is_packed():
    draw = np.random.default_rng(1)
    demand = {k: int(draw.integers(1, 20)) * (2 if k < 512 else 1) for k in range(1, 1024)}
    intervals, first_cut, sequences = packing.layout(demand)
    total = sum(k * v for k, v in demand.items())
    by_pattern = sum(k * (high - low) for k, parts in intervals.items() for low, high, often, *_ in parts if often)
    assert by_pattern >= 0.98 * total and sequences <= -(-total // 1024) + 10
    filled = np.zeros(first_cut, int)
    for k, parts in intervals.items():
        assert [p[0] for p in parts] == [0, *(p[1] for p in parts[:-1])] and parts[-1][1] == demand[k]
        for low, high, often, sequence, _ in parts:
            if often:
                filled[sequence : sequence + (high - low) // often] += k * often
    assert filled.max() <= 1024 and filled.min() >= 1024 - packing.WASTE


def test_line_dedup(spark):
    line = "The quick brown fox jumps over the lazy dog, é twice."
    rows = [(1, f"{line}\nshort\n{line}", "x"), (2, f"short\n{line[:-1]}\nA line of its own that stays here.", "x"), (3, line.replace("quick", "quack") + "\n" + line.replace("é", "è"), None), (4, None, "x"), (5, "", "x"), (None, f"x{line}", "x"), (6, line + " And more than one edit.", "x")]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1]["text"] == f"{line}\nshort" and got[2]["text"] == "short\nA line of its own that stays here."
    assert got[3]["text"] == "" and got[3]["n_dropped"] == 2 and got[None]["text"] == "" and got[4]["text"] is None and got[5]["text"] == ""
    assert got[6]["n_dropped"] == 0 and got[3]["k"] is None
    assert linededup.dedup_lines(empty(spark)).count() == 0
    clashing = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(f"keep {c}") for c in ("d", "gone", "__gone", "__key", "n_lines", "line", "first")})
    again = linededup.dedup_lines(clashing).collect()
    assert {r["doc_id"]: (r["text"], r["n_dropped"]) for r in again} == {k: (r["text"], r["n_dropped"]) for k, r in got.items()}
    assert {r[c] for r in again for c in ("d", "gone", "__gone", "__key", "line", "first")} == {f"keep {c}" for c in ("d", "gone", "__gone", "__key", "line", "first")}
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(12_000))
    far = spark.createDataFrame([(1, long, "x"), (2, long[:6_000] + long[6_001:], "x"), (2, long + "\n" + long, "x")], DOCS)
    assert sorted(r["n_dropped"] for r in linededup.dedup_lines(far).collect()) == [0, 1, 2]


def test_line_dedup_against_brute_force(spark):
    draw = random.Random(2)
    bases = ["".join(draw.choice("abc ") for _ in range(draw.randrange(20, 40))) for _ in range(15)]
    lines = []
    for b in bases * 4:
        i = draw.randrange(len(b))
        lines.append(draw.choice([b, b[:i] + "z" + b[i:], b[:i] + b[i + 1 :], b[:i] + "q" + b[i + 1 :]]))
    rows = [(k, "\n".join(lines[k * 6 : k * 6 + 6]), "x") for k in range(10)]
    flat = [(k, n, s) for k, t, _ in rows for n, s in enumerate(t.split("\n"))]

    def alike(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]

    want: dict = {k: [] for k, _, _ in rows}
    for at, (k, n, s) in enumerate(flat):
        if len(s) < 20 or not any(alike(s, e) for _, _, e in flat[:at] if len(e) >= 20):
            want[k].append(s)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {k: "\n".join(v) for k, v in want.items()}


def test_warc(spark, tmp_path):
    html = "<p>" + "é" * 80
    rows = [(5, "http://a", html), (2, None, html), (9, "u", html), (1, "u", "tiny"), (3, "u", "tiny"), (4, "u", None), (None, "u", html), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, archive_bytes=300).collect()}
    assert got == {5: (163, "revisit", 2), 2: (163, "response", None), 9: (163, "revisit", 2), None: (163, "revisit", 2), 1: (4, "response", None), 3: (4, "response", None), 4: (0, "response", None), 7: (280, "response", None)}
    assert warc.round_trip(spark.createDataFrame([], pages.schema)).count() == 0
    many = [(i, "u", html * 40_000 if i < 2 else f"{i} " * 200) for i in [0, 1, 1, *range(2, 40)]]
    clashing = spark.createDataFrame(many, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("digest", "size", "first", "n", "refers_to")})
    path = f"file://{tmp_path}"
    warc.write_monoliths(clashing, f"{path}/one", archive_bytes=1 << 20)
    warc.normalise(spark, f"{path}/one", f"{path}/many", archive_bytes=500)
    again = warc.read_archives(spark, f"{path}/many", read_bytes=2000)
    assert again.rdd.getNumPartitions() > 1
    found = again.collect()
    assert sorted(r["page_id"] for r in found) == sorted(r[0] for r in many) and {r["payload_bytes"] for r in found if r["page_id"] < 2} == {163 * 40_000}
    assert [(r["record_type"], r["refers_to"]) for r in found if r["page_id"] == 1] == [("revisit", 0)] * 2
    raws = [warc.record("response", i, "u", b"x" * i, i, "d", None) for i in range(5)]
    assert list(warc.records_of(gzip.compress(b"".join(raws)) + b"\0", 7)) == raws


def test_decontamination(spark):
    items = [(1, text(100, 30) + ". " + text(101, 6) + "."), (2, text(102, 20)), (3, ""), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, text(200, 300) + " " + items[0][1] + " " + text(201, 300), "x"), (2, text(202, 500), "x"), (3, None, "x"), (4, "", "x"), (None, items[1][1], "x"), (5, items[0][1][:100], "x")]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in decontamination.find_leaks(docs, bench).collect()) == [(0, 2), (1, 1)]
    assert {r["doc_id"] for r in decontamination.drop_leaks(docs, bench).collect()} == {2, 3, 4, 5}
    assert decontamination.find_leaks(docs, bench.where("item_id > 2")).count() == 0
    assert decontamination.find_leaks(empty(spark), bench).count() == 0


def test_wand_is_exact():
    draw = random.Random(3)
    index = decontamination.Index.build([(i, " ".join(draw.choices(WORDS, k=draw.randrange(3, 80)))) for i in range(400)])
    assert len(index.parts) > 2
    for part in index.parts:
        n = len(part.item_ids)
        for _ in range(60):
            terms = np.unique([part.local[index.terms[w]] for w in draw.choices(WORDS, k=12)])
            terms = terms[terms >= 0]
            score = np.zeros(n)
            for t in terms:
                score[part.postings[t]] += part.impacts[t]
            got = part.wand(terms, 0.3)
            assert sorted(i for i, _ in got) == np.nonzero(score >= 0.3 - 1e-9)[0].tolist() and all(abs(x - score[i]) < 1e-9 for i, x in got)


def plain_leaks(docs, items, threshold, overlap):
    """BM25 of every passage with every item, term by term."""
    split = {i: decontamination.words_of(t) for i, t in items if decontamination.words_of(t)}
    n, mean = len(split), sum(map(len, split.values())) / len(split)

    def weight(t, words):
        seen = sum(t in w for w in split.values())
        f = words.count(t)
        return np.log(1 + (n - seen + 0.5) / (seen + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / mean))

    out = {}
    for d, text in docs:
        words = decontamination.words_of(text)
        for i, item in items:
            if i not in split or not words:
                continue
            longest = next(4**k for k in range(20) if 4**k >= len(split[i]))
            question, answer = decontamination.question_answer(item)
            size = min(5, len(question))
            asked = {" ".join(question[k : k + size]) for k in range(len(question) - size + 1)}
            for s in range(0, max(1, len(words) - longest - 15), longest):
                passage = words[s : s + 2 * longest + 16]
                score = sum(weight(t, split[i]) for t in set(split[i]) & set(passage)) / sum(weight(t, split[i]) for t in set(split[i]))
                has = {" ".join(passage[k : k + size]) for k in range(max(1, len(passage) - size + 1))}
                q, a = len(asked & has) / len(asked), len(set(answer) & set(passage)) / len(set(answer))
                if score >= threshold and q >= overlap and a >= overlap and score > out.get((d, i), (0,))[0] + 1e-12:
                    out[d, i] = (score, q, a, s)
    return out


def test_leaks_against_brute_force(spark):
    draw = random.Random(8)
    items = [(i, text(i, n) + ". " + text(i + 50, 5) + ".") for i, n in enumerate((4, 9, 14, 30, 60, 200))] + [(9, text(70, 3)), (10, "short"), (11, "")]
    docs = []
    for d in range(30):
        words = text(3000 + d, 120).split()
        for i in draw.sample(range(8), 2):
            part = items[i][1].split()
            part = [w for w in part if draw.random() > draw.choice([0, 0, 0.03, 0.3])]
            at = draw.randrange(len(words))
            words[at:at] = part
        docs.append((d, " ".join(words * draw.choice([1, 1, 4]))))
    want = plain_leaks(docs, items, 0.5, 0.8)
    assert 20 < len(want) < 80
    table_, bench = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS + ", item_id int"), spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, w string")
    for shard_items in (100, 4):
        got = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in decontamination.find_leaks(table_, bench, shard_items=shard_items).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)
        left = decontamination.drop_leaks(table_, bench, shard_items=shard_items)
        assert {r["doc_id"] for r in left.collect()} == set(range(30)) - {d for d, _ in want} and left.columns == table_.columns


def plain_em(counts, rounds):
    """Two classes, labellers that err independently, by products of probabilities."""
    votes = {p: [p // 3**k % 3 for k in range(6, -1, -1)] for p in counts}
    good = {p: 0.1 if 2 in v else 0.9 for p, v in votes.items()}
    for _ in range(rounds):
        said = {(c, k, x): 0.1 + sum(n * (good[p] if c else 1 - good[p]) for p, n in counts.items() if votes[p][k] == x) for c in (0, 1) for k in range(7) for x in (1, 2)}
        prior = sum(n * good[p] for p, n in counts.items()) / sum(counts.values())
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        new = {}
        for p, v in votes.items():
            odds = [1 - prior, prior]
            for c in (0, 1):
                for k, x in enumerate(v):
                    odds[c] *= said[c, k, x] / (said[c, k, 1] + said[c, k, 2]) if x else 1
            new[p] = odds[1] / (odds[0] + odds[1])
        done = max(abs(new[p] - good[p]) for p in new) < 1e-6
        good = new
        if done:
            break
    return good


def test_expectation_maximisation():
    draw = random.Random(4)
    counts = {}
    for _ in range(3000):
        bad = draw.random() < 0.15
        p = 0
        for k in range(7):
            p = p * 3 + (0 if draw.random() < 0.3 else 2 if (draw.random() < 0.9 - k / 20) == bad else 1)
        counts[p] = counts.get(p, 0) + 1
    prior, _, posterior = quality.expectation_maximisation(counts)
    want = plain_em(counts, 200)
    assert all(abs(posterior[p] - want[p]) < 1e-6 for p in counts) and 0.8 < prior < 0.9


def test_labellers_see_whole_texts():
    for n in (3, 62, 63, 64, 65, 500):
        assert quality.votes("7" * n, ["7" * n])[3] == 2 and quality.votes("7" * n + ".", ["7" * n + "."])[3] == 2
    assert quality.shape("x" * 64 + "9") != quality.shape("x" * 65) and quality.shape("x" * 10) == quality.shape("x" * 1000)


def test_quality(spark):
    good = [(i, " ".join(w.capitalize() if j % 9 == 0 else w + "." if j % 9 == 8 else w for j, w in enumerate(text(i, 80).split())), "x") for i in range(120)]
    bad = [(1000 + i, " ".join([WORDS[i % 30]] * 60), "x") for i in range(15)] + [(2000 + i, text(i, 50).upper().replace(" ", "!! ") + "!!", "x") for i in range(15)]
    got = {r["doc_id"]: r["keep"] for r in quality.classify(spark.createDataFrame([*good, *bad, (9000, None, "x"), (9001, "", "x")], DOCS)).collect()}
    assert all(got[i] for i, _, _ in good) and not any(got[i] for i, _, _ in bad) and not got[9000] and not got[9001]
    assert quality.classify(empty(spark)).count() == 0
    rows = [*good, *good[:3], *bad, (9000, None, "x"), (None, good[0][1], "x"), (9002, good[0][1] * 200, "x")]
    clashing = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(f"keep {c}") for c in ("m", "h", "_m", "bins", "pattern")})
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns and sorted((r["doc_id"] or -1, r["text"], r["m"], r["_m"], r["pattern"]) for r in kept.collect()) == sorted((r[0] or -1, r[1], "keep m", "keep _m", "keep pattern") for r in rows if r[1] and r[0] not in {b[0] for b in bad})
    assert quality.keep_good(empty(spark)).count() == 0


def test_toxicity(spark):
    toxic, plain = [text(i) + " grumbleworst " + text(-i, 20) for i in range(1, 60)], [text(1000 + i) for i in range(120)]
    score = toxicity.train(toxic, plain).scorer()
    assert score(text(5000) + " GRUMBLEWORST!") > 0.5 > max(score(text(6000 + i)) for i in range(20))
    assert score(None) == score("") == score("12 ..") < 0.5
    docs = spark.createDataFrame([(1, text(1), "x"), (None, None, "x")], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.learn(docs, labels)).collect()
    assert [r["predicted"] for r in got] == [0, 0] and {r["doc_id"]: r["held_out"] for r in got}[None]
    assert {r["doc_id"]: r["held_out"] for r in got}[1] == (zlib.crc32(b"1") % 5 == 0)
    model = toxicity.train(toxic, plain)
    assert toxicity.score_toxicity(empty(spark), model).count() == 0
    long = [(1, text(5000, 30_000) + " grumbleworst", "x"), (2, text(5000, 30_000), "x"), (2, text(5000, 30_000), "x"), (None, "grumbleworst " * 3, "x")]
    again = toxicity.score_toxicity(spark.createDataFrame(long, DOCS).withColumns({"score": F.lit(9), "predicted": F.lit(9)}), model).collect()
    assert len(again) == 4 and len({r["score"] for r in again if r["doc_id"] == 2}) == 1 and [r["predicted"] for r in again if r["doc_id"] is None] == [1]


def test_posteriors_by_hand():
    draw = np.random.default_rng(1)
    emit, trans, begin = draw.normal(size=(11, 3)), draw.normal(size=(3, 3)), draw.normal(size=3)
    first = np.zeros(11, bool)
    first[[0, 4, 5]] = True
    got, steps = langid.posteriors(emit, trans, begin, first, step=4, pairs=True)
    expected = np.zeros((3, 3))
    for a, b in ((0, 4), (4, 5), (5, 11)):
        total, marginal, pairs = 0.0, np.zeros((b - a, 3)), np.zeros((3, 3))
        for path in np.ndindex(*[3] * (b - a)):
            p = np.exp(begin[path[0]] + sum(emit[a + i, s] for i, s in enumerate(path)) + sum(trans[s, t] for s, t in zip(path, path[1:])))
            total += p
            for i, s in enumerate(path):
                marginal[i, s] += p
            for s, t in zip(path, path[1:]):
                pairs[s, t] += p
        assert np.allclose(got[a:b], marginal / total)
        expected += pairs / total
    assert np.allclose(steps, expected)


def test_language(spark):
    en, de = "the house of things and other".split(), "das haus der dinge und andere".split()
    rows = [(i, " ".join(random.Random(i).choices(en if i % 2 else de, k=30)), "x") for i in range(80)] + [(100, None, "x"), (101, "12 !", "x"), (102, " ".join(en * 3 + de), "x")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    got = {r["doc_id"]: r for r in langid.predict_language(docs, langid.learn(docs.where("doc_id < 100"))).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(80))
    odd = spark.createDataFrame([(1, "½ ² ① Ⅳ 12", "x"), (2, "the" * 5000 + " dinge", "x"), (3, " ".join(de * 3000), "x"), (3, " ".join(de * 3000), "x"), (None, "the", "x")], DOCS).withColumn("score", F.lit("x"))
    model = langid.learn(docs.where("doc_id < 100"))
    more = [(r["doc_id"], r["lang_pred"]) for r in langid.predict_language(odd, model).collect()]
    assert more[0] == (1, "und") and more[2:] == [(3, "de"), (3, "de"), (None, "en")]
    assert langid.words_of("½ x² " + "字" * 95) == ["x", "字" * 40, "字" * 40, "字" * 15] and langid.words_of("हिन्दी भाषा") == ["हिन्दी", "भाषा"]
    nothing = langid.learn(docs.where("doc_id < 0"))
    assert {r["lang_pred"] for r in langid.predict_language(odd, nothing).collect()} == {"und"} and langid.predict_language(odd.limit(0), model).count() == 0
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[102]["lang_pred"] == "en" and 0.5 < got[102]["score"] < 0.95


def test_neighbours(spark):
    """Of 6000 vectors 60 are scored exactly, so what is found is the quantiser's doing."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(6000, 24))
    x[200:260] = x[0]
    x[1200:1300] = x[50] * draw.uniform(0.1, 9, (100, 1))
    x[107] = x[100] * 1e-200
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9050, [0.0] * 24), (9100, [float("nan")] * 24), (9150, [1.0]), (None, x[1].tolist()), (107, x[100].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"row": F.lit("x"), "unit": F.lit("y")})
    got = quantisation.nearest(vectors, rerank=60, fit_rows=2048).collect()
    x[107] = x[100]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = total = 0
    for q in range(0, 6000, 50):
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        s = np.round(u @ u[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(6000), -s))[:5].tolist()
        if q == 100:
            assert mine[:2] == [107, 107]
            continue
        found, total = found + len(set(mine) & set(want)), total + 5
        if q in (0, 50, 200, 250, 1200, 1250):
            assert mine == want
    assert found / total >= 0.9 and {r["query_id"] for r in got} == set(range(0, 6000, 50))
    assert all(r["rank"] and np.isfinite(r["score"]) for r in got)
    assert quantisation.nearest(vectors.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["wide", "crowded"])
def test_neighbours_that_codes_cannot_tell(spark, kind):
    """Vectors of more dimensions than codes describe, and crowds closer together than the codes' error."""
    draw, n = np.random.default_rng(7), 3000
    x = draw.normal(size=(n, 192)) if kind == "wide" else draw.normal(size=(3, 16))[draw.integers(3, size=n)] + 1e-5 * draw.normal(size=(n, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in quantisation.nearest(vectors, rerank=60, fit_rows=1024).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, n, 50):
        s = u @ u[q]
        s[q] = -9
        mine = [got[q, r] for r in range(1, 6)]
        # the order of scores that differ in their last digits is open
        assert len({*mine}) == 5 and np.abs(s[mine] - np.sort(s)[::-1][:5]).max() <= 2e-12


def test_language_spans(spark):
    en, de = "the house of things and other".split(), "das haus der dinge und andere".split()
    model = langid.train([(" ".join(random.Random(i).choices(en if i % 2 else de, k=30)), "en" if i % 2 else "de") for i in range(60)] + [(" ".join(en) + "\n" + " ".join(de), "en")] * 20)
    mixed = "The house of things; das Haus der Dinge und andere. 12"
    docs = spark.createDataFrame([(1, mixed, "x"), (2, None, "x"), (None, "12 .", "x"), (3, "", "x")], DOCS)
    got = {r["doc_id"]: r["spans"] for r in langid.label_spans(docs, model).collect()}
    assert [(mixed[s["start"] : s["end"]], s["lang"]) for s in got[1]] == [("The house of things", "en"), ("das Haus der Dinge und andere", "de")]
    assert got[2] == got[3] == got[None] == [] and all(0.5 < s["score"] <= 1 for s in got[1])
    assert langid.label_spans(empty(spark), model).count() == 0
