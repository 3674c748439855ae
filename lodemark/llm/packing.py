"""Packing of tokenised documents into sequences by cutting-stock column generation.

Full sequences are cut off a document's front; what remains, by length, is the demand of a cutting-stock problem. A linear
program over patterns (how often each length is in a sequence) is solved by the simplex method with columns priced by a
knapsack dynamic program; it starts from patterns that fill a sequence behind the longest length left. Rounded-down
patterns with little waste are assigned to documents ranked within their length, and what the rounding leaves is filled
into whole patterns in the same way. Only lengths that then fit no pattern well are laid end to end and cut at the sequence
boundaries, so every sequence but the last is full to within the waste allowed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemark.llm.common import buckets_for, cut, scratch, session, small_batches, with_prefix, write_text

CAPACITY = 1024
#: Tokens that a pattern may leave empty.
WASTE = 8
#: Columns generated at most, should the program not come within its bound before: a large table needs few or none.
COLUMNS = 5000
#: Lengths tried, the longest first, as one of three that fill a sequence.
TRIED = 16
#: Rows of a length that one task ranks; a common length has as many buckets as that takes.
BUCKET_ROWS = 1000
# The pre-tokenisation pattern of the public byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> token ids as the tokenizers library gives them with add_special_tokens=False.

    Strings of added tokens in a text are those tokens. A plain byte-level BPE (ids in order of their merges, added tokens
    taken as they stand) runs as the same ranks in a faster library; any other file through the tokenizers library itself.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    before, added = model.get("pre_tokenizer") or {}, model.get("added_tokens", [])
    as_they_stand = not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))
    if model["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not model.get("normalizer") and as_they_stand:
        import tiktoken

        byte_of, special = _byte_of(), {t["content"]: t["id"] for t in added}
        ranks = {bytes(byte_of[c] for c in token): k for token, k in model["model"]["vocab"].items() if token not in special}
        encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> list[int]:
            if any(t in text for t in special):
                return encoding.encode(text, allowed_special="all")
            return encoding.encode_ordinary(text)

        return encode
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def _tokenised(path: str, capacity: int):
    """Ids of each text and the 0, little-endian, in full sequences and a rest; nth numbers the full ones of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, step, part, nth = encoder(path), 4 * capacity, TaskContext.get().partitionId(), 0
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                ids = np.array([*encode(text or ""), 0], "<u4").tobytes()
                full = len(ids) // step
                rest = ids[full * step :]
                rows.append((part, nth, len(ids) // 4, [ids[k * step : (k + 1) * step] for k in range(full)], len(rest) // 4, rest))
                nth += full
            yield pd.concat([pdf[["uid", "doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["part", "nth", "doc_tokens", "full", "rest", "rest_ids"])], axis=1)

    return run


def _price(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most that worths of lengths add up to within the capacity, each length as often as wanted, and how often each."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], took[c] = best[c - 1], -1
        if k := fits[c]:
            total = worth[:k] + best[c - lengths[:k]]
            at = int(total.argmax())
            if total[at] > best[c]:
                best[c], took[c] = total[at], at
    often, c = np.zeros(len(lengths)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            often[took[c]] += 1
            c -= lengths[took[c]]
    return float(best[capacity]), often


def _fill(have: np.ndarray, room: int, least: float, waste: int) -> list[int] | None:
    """Up to three lengths of which at least `least` is there and that fill room to within the waste; None if there are none."""

    def two(left: np.ndarray, total: int) -> list[int] | None:
        both = np.minimum(left[1:total], left[total - 1 : 0 : -1])
        if total % 2 == 0 and len(both):
            both[total // 2 - 1] /= 2
        return [x := int(both.argmax()) + 1, total - x] if len(both) and both.max() >= least else None

    totals = range(room, max(room - waste, 0) - 1, -1)
    for total in totals:
        if not total:
            return []
        if have[total] >= least:
            return [total]
        if found := two(have, total):
            return found
    for total in totals:
        for x in np.nonzero(have[:total] >= least)[0][: -TRIED - 1 : -1].tolist():
            rest = have.copy()
            rest[x] -= least
            if found := two(rest, total - x):
                return [x, *found]
    return None


def greedy(demand: dict[int, float], capacity: int, waste: int, whole: bool) -> list[tuple[float, dict[int, int], int]]:
    """Patterns by turns behind the longest length left: how often, lengths, and the length that is used up by it.

    Not whole: all demand is met in fractions, and no pattern has a length that an earlier one used up. Whole: whole numbers,
    and only patterns with no more waste than allowed.
    """
    left, least, out = np.zeros(capacity + 1), 1 if whole else 1e-9, []
    for k, v in demand.items():
        left[k] = v
    while len(there := np.nonzero(left >= least)[0]):
        have, pattern, room, more = left.copy(), {}, capacity, [int(there[-1])]
        while more:
            for k in more:
                pattern[k] = pattern.get(k, 0) + 1
                have[k] -= least
                room -= k
            if not room:
                break
            filled = _fill(have, room, least, waste)
            more = filled if filled is not None else np.nonzero(have[: room + 1] >= least)[0][-1:].tolist()
        used_up = min(pattern, key=lambda k: left[k] / pattern[k])
        times = left[used_up] / pattern[used_up]
        if whole:
            times = int(times)
            if room > waste or not times:
                left[there[-1]] = 0
                continue
        for k, often in pattern.items():
            left[k] -= times * often
        if not whole:
            left[used_up] = 0
        out.append((times, pattern, used_up))
    return out


def solve(demand: dict[int, int], capacity: int = CAPACITY, columns: int = COLUMNS, waste: int = WASTE) -> list[tuple[float, dict[int, int]]]:
    """Patterns of the (nearly) optimal linear program with how often each is used, not rounded.

    It ends at the optimum, or where no packing in whole sequences can need fewer than it does.
    """
    lengths = np.array(sorted(k for k, v in demand.items() if v), np.int64)
    if not len(lengths):
        return []
    need = np.array([demand[int(k)] for k in lengths], float)
    # a little more of each length, so that no two are used up at once and no step of the simplex method stands still
    moved = need + np.random.default_rng(42).random(len(need)) * 2e-4
    at = {int(k): i for i, k in enumerate(lengths)}
    fit = (capacity // lengths).astype(float)
    patterns, used, inverse, bound = np.diag(fit), np.zeros(len(lengths)), np.eye(len(lengths)), float((lengths * need).sum()) / capacity
    # each pattern stands for the length it uses up, in none after it: a triangular matrix, so a basis to start from, whose
    # inverse takes a row operation for each entry (np.linalg.inv was seen to hang in a process with a running JVM)
    single = set(range(len(lengths)))
    for times, pattern, used_up in greedy(dict(zip(at, moved)), capacity, waste, False):
        i = at[used_up]
        single.discard(i)
        patterns[i, i], used[i] = 0, times
        inverse[i] /= pattern[used_up]
        for k, often in pattern.items():
            patterns[at[k], i] = often
            if k != used_up:
                inverse[at[k]] -= often * inverse[i]
    for i in single:
        inverse[i] /= fit[i]
    for _ in range(columns):
        if used.sum() <= np.ceil(bound - 1e-6) + 0.1:
            break
        worth = inverse.sum(axis=0)
        value, column = _price(lengths, worth, capacity)
        if value <= 1 + 1e-6:
            break
        into = inverse @ column
        ratio = np.where(into > 1e-7, used / np.where(into > 1e-7, into, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        used = used - step * into
        used[out] = step
        np.maximum(used, 0, out=used)
        pivot = inverse[out] / into[out]
        inverse -= np.outer(into, pivot)
        inverse[out] = pivot
        patterns[:, out] = column
    used = np.maximum(inverse @ need, 0)
    return [(float(used[p]), {int(lengths[i]): int(patterns[i, p]) for i in np.nonzero(patterns[:, p])[0]}) for p in range(len(lengths)) if used[p] >= 1 - 1e-9]


def layout(demand: dict[int, int], capacity: int = CAPACITY, waste: int = WASTE, columns: int = COLUMNS) -> tuple[dict[int, list[tuple]], int, int]:
    """For each length, intervals of ranks (low, high, often, sequence, offset), then the first sequence of what is cut, and the number of all.

    often > 0: rank r is the piece (r - low) % often of sequence + (r - low) // often, from offset on. often = 0: laid end
    to end from token `offset` of the part that is cut.
    """
    at, sequence, out = dict.fromkeys(demand, 0), 0, {k: [] for k in demand}

    def place(used: float, pattern: dict[int, int]) -> None:
        nonlocal sequence
        times = min(int(used + 1e-9), *((demand[k] - at[k]) // often for k, often in pattern.items()))
        if times < 1 or capacity - sum(k * often for k, often in pattern.items()) > waste:
            return
        offset = 0
        for k, often in sorted(pattern.items(), reverse=True):
            out[k].append((at[k], at[k] + often * times, often, sequence, offset))
            at[k] += often * times
            offset += k * often
        sequence += times

    for used, pattern in solve(demand, capacity, columns, waste):
        place(used, pattern)
    for used, pattern, _ in greedy({k: v - at[k] for k, v in demand.items()}, capacity, waste, True):
        place(used, pattern)
    tokens = 0
    for k in sorted(demand, reverse=True):
        if at[k] < demand[k]:
            out[k].append((at[k], demand[k], 0, 0, tokens))
            tokens += (demand[k] - at[k]) * k
    return out, sequence, sequence + -(-tokens // capacity)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, waste: int = WASTE, columns: int = COLUMNS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every row of docs is a document of its token ids and an id 0; a null or empty text is the id 0 alone. Null and repeated
    ids keep all their pieces. The longest texts become many full sequences. An empty table gives an empty one; columns
    other than the two are not looked at. The demand that comes to the driver has at most `capacity` - 1 rows.
    """
    spark = session(docs)
    small_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # written, so that a row's uid and its ids never change again
    tokens = cut(rows.mapInPandas(_tokenised(tokenizer, capacity), "uid long, doc_id long, part int, nth long, doc_tokens long, full array<binary>, rest int, rest_ids binary"), "tokens")
    demand = {r["rest"]: r["n"] for r in tokens.where("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}
    intervals, first_cut, first_full = layout(demand, capacity, waste, columns)
    path = scratch(spark, "intervals")
    write_text(spark, f"{path}/intervals.json", "\n".join(json.dumps({"rest": k, "parts": [dict(zip(("low", "high", "often", "sequence", "offset"), x)) for x in v], "buckets": buckets_for(demand[k], BUCKET_ROWS)}) for k, v in intervals.items()))
    # one row for each length below the capacity, with no more intervals in all than patterns have lengths: broadcast whatever the input
    table = spark.read.schema("rest int, parts array<struct<low: long, high: long, often: long, sequence: long, offset: long>>, buckets int").json(path)
    bucket = F.pmod(F.xxhash64("uid"), F.col("buckets")).cast("int")
    rests = tokens.where("rest > 0").select("uid", "rest").join(F.broadcast(table.select("rest", "buckets")), "rest")
    ranked = with_prefix(rests, ["rest"], [F.col("uid")], bucket, F.lit(1), "r").drop("buckets")
    placed = ranked.join(F.broadcast(table.select("rest", "parts")), "rest").withColumn("i", F.element_at(F.filter("parts", lambda x: (x["low"] <= F.col("r")) & (F.col("r") < x["high"])), 1))
    nth, at = F.col("r") - F.col("i.low"), F.col("i.offset") + (F.col("r") - F.col("i.low")) * F.col("rest")
    in_pattern = F.col("i.often") > 0
    placed = placed.select(
        "uid",
        F.when(in_pattern, F.col("i.sequence") + F.floor(nth / F.col("i.often"))).otherwise(F.lit(first_cut) + F.floor(at / capacity)).alias("sequence_id"),
        F.when(in_pattern, F.col("i.offset") + nth % F.col("i.often") * F.col("rest")).otherwise(at % capacity).alias("offset"),
    )
    whole = tokens.where("rest > 0").select("uid", "doc_id", "doc_tokens", F.col("rest").cast("long").alias("rest"), "rest_ids").join(placed, "uid").withColumn("room", F.least("rest", F.lit(capacity) - F.col("offset")))
    start = F.col("doc_tokens") - F.col("rest")
    head = F.struct(start.alias("start"), F.col("room").alias("length"), F.substring("rest_ids", F.lit(1), (F.col("room") * 4).cast("int")).alias("ids"), F.col("sequence_id"), F.col("offset"))
    tail = F.struct((start + F.col("room")).alias("start"), (F.col("rest") - F.col("room")).alias("length"), F.substring("rest_ids", (F.col("room") * 4 + 1).cast("int"), (F.col("rest") * 4).cast("int")).alias("ids"), (F.col("sequence_id") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    piece = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    short = whole.select("doc_id", "doc_tokens", F.explode(F.when(F.col("room") < F.col("rest"), F.array(head, tail)).otherwise(F.array(head))).alias("e")).select("doc_id", "doc_tokens", "e.*").select(*piece)
    # one row for each task that tokenised; written, so its size is known, and the join broadcasts it or not by that
    counts = tokens.where("size(full) > 0").groupBy("part").agg(F.sum(F.size("full")).alias("n"))
    before = cut(counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")), "before")
    long = tokens.where("size(full) > 0").select("doc_id", "doc_tokens", "part", "nth", F.posexplode("full").alias("k", "ids")).join(before, "part")
    long = long.select("doc_id", (F.col("k") * F.lit(capacity)).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), "ids", "doc_tokens", (F.lit(first_full) + F.col("before") + F.col("nth") + F.col("k")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.union(long.select(*piece))


def with_digests(pieces: DataFrame) -> DataFrame:
    """pieces with ids_crc32 in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def vocabulary() -> str:
    """Where the public byte-level vocabulary of the queries lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return with_digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary()))
