"""Chat logs and recommendation tallies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .analytics import latest_by_phone

STAMP = r"\[([^\]]+)\]\s*[^:]+:\s*"
#: White space at either end of a line, as chat exports have it.
_ENDS = r"^[\s\x0B\p{Z}\x{FEFF}]+|[\s\x0B\p{Z}\x{FEFF}]+$"
# The marks of a recommendation's lines.
PLACE, LINK = "📍", "🔗"
WHY, BEST = r"(?i)^Why (he|she) may be a good fit:\s*", r"(?i)^Best for:\s*"
FIRST_LINE = r"^(\d+)[.)]\s+(.+)$"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def messages(text: Column) -> Column:
    """Array of struct<stamp, body> of a chat log: what follows each ``[stamp] sender:``, blanks left out."""
    stamps = F.regexp_extract_all(text, F.lit(STAMP), F.lit(1))
    bodies = F.transform(F.slice(F.split(text, STAMP), F.lit(2), F.greatest(F.size(stamps), F.lit(1))), _strip)
    return F.filter(F.zip_with(stamps, bodies, lambda s, b: F.struct(s.alias("stamp"), b.alias("body"))), lambda m: F.coalesce(m["body"], F.lit("")) != "")


def recommendation(block: Column) -> Column:
    """rank, name, location, title, why, best_for, link of a message ``N. Name`` (or ``N) Name``); null for other messages.

    A fold over the lines after the first, with a state: after the place, blank lines are
    passed over and the first line that opens no other part is the title; a reason goes on
    until a blank line, ``Best for:`` or a link, what it is best for until a blank line or a
    link, their lines joined by blanks.  A part that comes again replaces the former one.
    """
    none = F.lit(None).cast("string")
    lines = F.transform(F.split(block, r"\r?\n"), _strip)
    head = F.get(lines, 0)

    def rest(x: Column, mark: str) -> Column:
        return _strip(F.regexp_replace(x, mark, ""))

    def longer(text: Column, x: Column) -> Column:
        return F.when(text == "", x).otherwise(F.concat(text, F.lit(" "), x))

    def step(acc: Column, x: Column) -> Column:
        mode, filled, link = acc["mode"], x != "", F.startswith(x, F.lit(LINK))
        title = (mode == "place") & filled & ~link & ~F.startswith(x, F.lit("Why ")) & ~F.startswith(x, F.lit("Best for"))
        waits = (mode == "place") & ~filled
        why_on = (mode == "why") & filled & ~link & ~x.rlike(BEST)
        best_on = (mode == "best") & filled & ~link
        opens = ~(title | waits | why_on | best_on)
        place, why, best = opens & F.startswith(x, F.lit(PLACE)), opens & x.rlike(WHY), opens & x.rlike(BEST)
        return F.struct(
            F.when(waits | place, "place").when(why_on | why, "why").when(best_on | best, "best").otherwise("").alias("mode"),
            F.when(place, rest(x, rf"^{PLACE}\s*")).otherwise(acc["location"]).alias("location"),
            F.when(title, x).otherwise(acc["title"]).alias("title"),
            F.when(why_on, longer(acc["why"], x)).when(why, rest(x, WHY)).otherwise(acc["why"]).alias("why"),
            F.when(best_on, longer(acc["best_for"], x)).when(best, rest(x, BEST)).otherwise(acc["best_for"]).alias("best_for"),
            F.when(opens & link, F.nullif(F.regexp_extract(x, rf"{LINK}\s*(https?:\S+)", 1), F.lit(""))).otherwise(acc["link"]).alias("link"),
        )

    start = F.struct(F.lit("").alias("mode"), none.alias("location"), none.alias("title"), F.lit("").alias("why"), F.lit("").alias("best_for"), none.alias("link"))
    done = F.aggregate(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), start, step)
    found = F.struct(
        F.regexp_extract(head, FIRST_LINE, 1).try_cast("int").alias("rank"), _strip(F.regexp_extract(head, FIRST_LINE, 2)).alias("name"), done["location"].alias("location"), done["title"].alias("title"),
        F.nullif(_strip(done["why"]), F.lit("")).alias("why"), F.nullif(_strip(done["best_for"]), F.lit("")).alias("best_for"), done["link"].alias("link"),
    )
    return F.when(head.rlike(FIRST_LINE), found)


def patient_text(turns: DataFrame, role: str = "user") -> DataFrame:
    """Everything one side said, in order."""
    said = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return turns.where(F.col("role") == role).groupBy("conv_id").agg(F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("patient_text"))


def tally(log: DataFrame, target: str, top: int | None = None) -> DataFrame:
    """(event_id, ts, target) -> count, share in percent and first sighting of each target, most frequent first."""
    counts = log.groupBy(target).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"))
    total = counts.agg(F.sum("n").alias("__total"))  # one row
    out = counts.join(F.broadcast(total)).withColumn("percent", F.round(100 * F.col("n") / F.col("__total"), 2)).drop("__total")
    if top:
        out = out.orderBy(F.desc("n"), target).limit(top)
    return out


#: Rows of either side that meet in one task at most, about.
SIDE = 4096
#: Left rows that are compared at a time, and how many times more a pair of postings costs than a place in a product of matrices.
CHUNK, COSTLIER = 128, 150


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Sizes of a column of lists, and what is in them."""
    whole = column.combine_chunks()
    whole = whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole
    return whole.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), whole.flatten()


def _positions(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every run, one run after another."""
    ends = np.cumsum(count)
    return np.repeat(begin - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _nearest(left: pa.Table, right: pa.Table) -> pa.Table:
    """left_id, right_id, shared, united: for each left row the most similar right rows, as near as rounding to six places cannot tell; of equal sizes the least right_id.

    Tokens of both sides are numbered.  Those that many rows have are multiplied as
    matrices, the others meet as pairs of postings.
    """
    (na, a), (nb, b) = _lists(left["a"]), _lists(right["b"])
    words = pc.unique(a)
    a, b = (pc.index_in(x, words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    row_a, row_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    row_b, b = row_b[b >= 0], b[b >= 0]
    df_a, df_b = (np.bincount(x, minlength=len(words)) for x in (a, b))
    common = np.flatnonzero(df_a * df_b * COSTLIER > len(na) * len(nb))
    place = np.full(len(words), -1, np.int64)
    place[common] = np.arange(len(common))
    dense = np.zeros((len(common), len(nb)), np.float32)
    hit = place[b] >= 0
    dense[place[b[hit]], row_b[hit]] = 1
    order = np.argsort(b, kind="stable")
    holders, starts = row_b[order], np.cumsum(df_b) - df_b
    ids = right["right_id"].combine_chunks().to_numpy(zero_copy_only=False)
    out = []
    for lo in range(0, len(na), CHUNK):
        n = min(CHUNK, len(na) - lo)
        mine = slice(*np.searchsorted(row_a, [lo, lo + n]))
        token, row = a[mine], row_a[mine] - lo
        own = np.zeros((n, len(common)), np.float32)
        often = place[token] >= 0
        own[row[often], place[token[often]]] = 1
        shared = (own @ dense).astype(np.int64)
        token, row = token[~often], row[~often]
        keys = np.repeat(row, df_b[token]) * len(nb) + holders[_positions(starts[token], df_b[token])]
        if len(keys):
            shared += np.bincount(keys, minlength=n * len(nb)).reshape(n, len(nb))
        united = na[lo : lo + n, None] + nb[None, :] - shared
        similar = shared / np.maximum(united, 1)
        r, c = np.nonzero((shared > 0) & (similar >= similar.max(axis=1, keepdims=True) - 2e-6))
        s, u = shared[r, c], united[r, c]
        order = np.lexsort((ids[c], u, s, r))
        r, c, s, u = r[order], c[order], s[order], u[order]
        first = np.ones(len(r), bool)
        first[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (u[1:] != u[:-1])
        out.append((r[first] + lo, c[first], s[first], u[first]))
    r, c, s, u = (np.concatenate(x) for x in zip(*out))
    return pa.table({"left_id": left["left_id"].take(pa.array(r)), "right_id": right["right_id"].take(pa.array(c)), "shared": pa.array(s, pa.int64()), "united": pa.array(u, pa.int64())})


def best_same_day(left: DataFrame, right: DataFrame, least: float = 0.08, side: int = SIDE) -> DataFrame:
    """Of the right rows of the same day, the one with the most similar token set (Jaccard) for each left row (ties: least right_id), if similar enough.

    left: (left_id, day, a); right: (right_id, day, b), arrays of distinct tokens.  The rows of
    each side and day are dealt into blocks of about ``side``; every left block of a day
    meets every right block, and only the best of each row leave a task: no day is in
    one place, and no pair in a shuffle.
    """
    sized = lambda df, n: df.where("day is not null").groupBy("day").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / side)).cast("int").alias(n))
    blocks = stage(sized(left, "of_left").join(sized(right, "of_right"), "day"), "days")  # days of both sides
    dealt = lambda df, key, n: df.join(blocks, "day").withColumn(n, F.pmod(F.xxhash64(key), F.col(f"of_{n}")).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(f"of_{n}") - 1)).alias(n)
    mine = dealt(left.where(F.size("a") > 0), "left_id", "left").select("day", "left", every("right"), "left_id", "a")
    theirs = dealt(right.where(F.size("b") > 0), "right_id", "right").select("day", every("left"), "right", "right_id", "b")
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((left, "left_id"), (right, "right_id"))}
    keys = ["day", "left", "right"]
    near = mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(lambda a, b: _nearest(a, b) if a.num_rows and b.num_rows else _none(a, b), f"left_id {kinds['left_id']}, right_id {kinds['right_id']}, shared long, united long")
    scored = near.select("left_id", "right_id", F.round(F.col("shared") / F.col("united"), 6).alias("similarity")).where(F.col("similarity") >= least)
    return scored.groupBy("left_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "right_id")).alias("m")).select("left_id", "m.right_id", (-F.col("m.s")).alias("similarity"))


def _none(left: pa.Table, right: pa.Table) -> pa.Table:
    return pa.table({"left_id": left["left_id"].slice(0, 0), "right_id": right["right_id"].slice(0, 0), "shared": pa.array([], pa.int64()), "united": pa.array([], pa.int64())})


def migrate_log(first: Column, second: Column, n: int = 10) -> Column:
    """The newer field, or the older one in its place, at most n entries."""
    return F.slice(F.coalesce(first, second), 1, n)


def match_sessions(left: DataFrame, right: DataFrame, least: float = 0.08) -> DataFrame:
    """Log entries of sessions: one with the session's telephone number first (the latest), else the most similar of the same day.

    left: (left_id, day, phone, a); right: (right_id, day, phone, seen, b), as ``best_same_day`` has them.
    """
    by_phone = latest_by_phone(left, right)
    rest = best_same_day(left.join(by_phone.select("left_id"), "left_id", "left_anti"), right, least)
    return by_phone.select("left_id", "right_id", F.lit(1.0).alias("similarity"), F.lit("phone").alias("how")).unionByName(rest.withColumn("how", F.lit("day")))
