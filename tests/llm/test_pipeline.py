"""Every stage of the pipeline against a plain version of itself, on documents with nulls, repeats, copies, junk and leaks."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from lodemark.llm import decontamination, packing, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __d string, line string, fp long"
WORDS = [a + b for a in ("ba", "ko", "ri", "ten", "lu", "mor", "sta", "vel") for b in ("da", "fi", "go", "sel", "nu", "ram", "tok")]


def sentences(seed, lines=6):
    draw = random.Random(seed)
    return "\n".join(" ".join(draw.choice(WORDS) + draw.choice(["", "s", "en", "ir"]) for _ in range(draw.randrange(8, 16))).capitalize() + "." for _ in range(lines))


ITEM = sentences(900, 3).replace("\n", " ")
COMMON = "This very line comes again and again in many documents."


def rows():
    out = [(i, sentences(i)) for i in range(60)]
    out += [(60 + i, sentences(300 + i, 3) + "\n" + COMMON[:-1] + str(i % 2) + "\n" + sentences(400 + i, 3)) for i in range(8)]
    out += [(70, sentences(500, 40)), (71, sentences(500, 40).replace("\n", " \n")), (72, sentences(500, 40).replace("\n", "  \n")), (None, sentences(500, 40).replace("\n", "   \n"))]
    out += [(80, sentences(81, 5) + "\n" + ITEM + "\n" + sentences(82, 5)), (83, sentences(84, 200)), (85, None), (86, ""), (87, "word " * 90), (88, "%$# " * 60)]
    out += [(90, sentences(91)), (90, sentences(91)), (90, sentences(92)), (None, sentences(93))]
    return [(i, t, "en", "s1", None if t is None else len(t), "x", "y", 7) for i, t in out]


def alike(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]


def plain_quality(docs):
    marks = [quality.mark(t) for _, t in docs]
    posterior = quality.expectation_maximisation(Counter(m[0] for m in marks))[2]
    w = quality.fit_scorer([(b, s, posterior[p]) for p, b, s in marks if b])
    return [d for d, (_, b, s) in zip(docs, marks) if quality.score(b, s, w) >= 0.5]


def plain_lines(docs):
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    assert len({(d, t) for d, t in docs}) == len(docs) - 1  # document 90, repeated whole: rows alike share one decision
    seen, out, decided = [], [], {}
    for d, t in docs:
        if (d, t) in decided:
            out += decided[d, t]
            continue
        lines = (t or "").split("\n")
        kept = []
        for s in lines:
            if len(s) < 20 or not any(alike(s, e) for e in seen):
                kept.append(s)
            if len(s) >= 20:
                seen.append(s)
        decided[d, t] = [] if lines and not kept else [(d, None if t is None else "\n".join(kept))]
        out += decided[d, t]
    return out


def plain_copies(docs):
    """Every pair by its estimated similarity; of each group the smallest id, of those the smallest text hash (not looked at)."""
    fps = [simhash.wide_fingerprint(t) for _, t in docs]
    label = list(range(len(docs)))
    for i, (n, x) in enumerate(fps):
        for j, (m, y) in enumerate(fps[:i]):
            differ = np.bitwise_count(x ^ y)
            if (n == m and not differ.any()) or (min(n, m) >= 0.8 * max(n, m) and differ[0] <= 24 and differ.sum() <= simhash.allowed_bits(np.array([n]), np.array([m]), 0.8, 512)[0]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if v == old else v for v in label]
    groups: dict = {}
    for g, (d, t) in zip(label, docs):
        groups.setdefault(g, []).append((d is None, d or 0, t or ""))
    return [min(g)[:2] for g in groups.values()]


def plain_leaks(docs, items):
    """Without an index or scores: passages at every word that hold 0.8 of an item's shingles and of its answer."""
    out = []
    for d, t in docs:
        words, hit = decontamination.words_of(t), False
        for item in items:
            q, a = decontamination.question_answer(item)
            n = len(decontamination.words_of(item))
            for s in range(max(1, len(words) - n + 1)):
                part = words[s : s + n + 4]
                hit |= len(decontamination.shingles(q) & decontamination.shingles(part)) >= 0.8 * len(decontamination.shingles(q)) and len(set(a) & set(part)) >= 0.8 * len(set(a))
        if not hit:
            out.append((d, t))
    return out


def of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, sentences(901, 3)), (3, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontaminate", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, folder)
    assert kept.columns == corpus_pipeline.COLUMNS and of(kept) == sorted(plain_quality([(r[0], r[1]) for r in rows()]), key=repr)
    assert {87, 88, 85, 86}.isdisjoint(d for d, _ in of(kept)) and len(of(kept)) == len(rows()) - 4
    lines = corpus_pipeline.lines(spark, kept, folder)
    assert of(lines) == sorted(plain_lines(of(kept)), key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())


def test_copies(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = sorted((d is None, d or 0) for d, _ in of(corpus_pipeline.near_duplicates(spark, docs, folder)))
    assert got == sorted(plain_copies(of(docs)))
    # two texts of one id are two documents; the repeated row is one; a null id gives way to others
    assert got.count((False, 90)) == 2 and {71, 72, 86}.isdisjoint(d for _, d in got) and got.count((True, 0)) == 1
    assert simhash.keep_one(docs).columns == docs.columns


def test_leaks(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = of(corpus_pipeline.decontaminate(spark, docs, folder))
    assert got == sorted(plain_leaks(of(docs), [ITEM, sentences(901, 3)]), key=repr) and 80 not in {d for d, _ in got}


def test_run(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, folder), "stage")
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    want = sorted([*tokenizer.encode(t, add_special_tokens=False).ids, 0] for _, t in of(docs))
    pieces = packing.pack(docs, packing.vocabulary()).collect()
    at = Counter()
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]] and 4 * r["length"] == len(r["ids"])
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 1024 and sum(at.values()) == sum(map(len, want)) and sorted(at) == list(range(len(at)))
    ids: dict = {}
    for r in sorted((r for r in pieces if r["doc_id"] is not None), key=lambda r: (r["doc_id"], r["doc_tokens"], r["start"])):
        ids.setdefault((r["doc_id"], r["doc_tokens"]), []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert all(i in want for i in ids.values()) and len(ids) >= len(want) - 2
    digests = {(r["doc_id"], r["start"], r["doc_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert digests == {(r["doc_id"], r["start"], r["doc_tokens"], r["ids_crc32"]) for r in packing.with_digests(packing.pack(docs, packing.vocabulary())).collect()}


def test_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
