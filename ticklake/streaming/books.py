"""Order books from snapshots and deltas.

``book_at`` is the distributed form: the last snapshot of a book and the later change of each level
are two aggregations, so one busy book is many tasks. ``fold_books`` checks every update in order
(continuity, crossing, scales, checksums). Its lines are cut at snapshots, and rows from one to the next
come sorted and pass through one state of bounded depth; no group is held. Deltas that come before their
snapshot wait in a bounded buffer. ``stream_books`` runs the same fold on a stream.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import as_of, running_last, running_sums
from ..sources.scratch import work_folder

OUT = "book string, ord long, seq long, validity string, reason string, best_bid double, best_ask double, levels int"
UPDATE = ["book", "ord", "snapshot", "first_seq", "last_seq", "previous_seq", "bids", "asks"]
RULES = ("spanning", "previous", "plus_one", "at_most_next", "drop_stale", "replace", "checksum")
#: Rules under which deltas wait for their snapshot, and how many, bytes and nanoseconds of them at most (fixed values).
BUFFERED, MOST_BUFFERED, MOST_BYTES, MOST_SPAN_NS = ("spanning", "previous", "plus_one"), 10_000, 4 << 20, 5_000_000_000
#: Columns that updates may have: a message's own checksum, its bytes, and the monotonic time it came at.
OPTIONAL = ("checksum", "bytes_len", "mono_ns")


def book_at(updates: DataFrame, *, keys: list[str] = ["book"]) -> DataFrame:  # noqa: B006
    """Resting levels after all ``updates`` (keys, ord, snapshot, side, price, quantity: one row a level;
    quantity 0 deletes). Snapshot rows of one book share their ord. Continuity isn't checked."""
    start = updates.where("snapshot").groupBy(*keys).agg(F.max("ord").alias("__start"))
    live = updates.join(start, keys).where(F.col("ord") >= F.col("__start"))
    last = live.groupBy(*keys, "side", "price").agg(F.max_by("quantity", "ord").alias("quantity"))
    return last.where("quantity > 0")


class Side:
    """Levels of a side by exact price: quantity and both as written."""

    def __init__(self, best_last: bool) -> None:
        self.best_last, self.prices, self.levels = best_last, [], {}

    def set(self, price: Decimal, level: tuple[Decimal, str, str] | None) -> None:
        known = price in self.levels
        if level is None:
            if known:
                del self.levels[price], self.prices[bisect_left(self.prices, price)]
            return
        if not known:
            insort(self.prices, price)
        self.levels[price] = level

    def best(self) -> Decimal | None:
        return self.prices[-1 if self.best_last else 0] if self.prices else None

    def trim(self, depth: int) -> None:
        while len(self.prices) > depth:
            del self.levels[self.prices.pop(0 if self.best_last else -1)]

    def from_best(self) -> list[Decimal]:
        return self.prices[::-1] if self.best_last else self.prices


def _within(value: Decimal, scale: int | None) -> bool:
    return scale is None or value.normalize().as_tuple().exponent >= -scale


@dataclass
class Book:
    """One book. Scales: digits that prices and quantities may have, None for any."""

    depth: int = 0
    price_scale: int | None = None
    quantity_scale: int | None = None
    bids: Side = field(default_factory=lambda: Side(True))
    asks: Side = field(default_factory=lambda: Side(False))
    seq: int | None = None
    bridged: bool = False
    validity: str = "uninitialized"
    waiting: list[dict] = field(default_factory=list)
    held: tuple[int, int | None, int | None] = (0, None, None)

    def crossed(self) -> bool:
        bid, ask = self.bids.best(), self.asks.best()
        return bid is not None and ask is not None and bid >= ask

    def trim(self) -> None:
        if self.depth:
            self.bids.trim(self.depth)
            self.asks.trim(self.depth)

    def read(self, levels: list) -> list[tuple[Decimal, Decimal, str, str]] | None:
        """Exact (price, quantity) with their text; None if one has more digits than the scales allow.
        A delete with too many digits can't hit a level and is left out."""
        out = []
        for price, quantity in levels:
            p, q = Decimal(str(price)), Decimal(str(quantity))
            if not _within(p, self.price_scale) or not _within(q, self.quantity_scale):
                if q == 0:
                    continue
                return None
            out.append((p, q, str(price), str(quantity)))
        return out

    def snapshot(self, bids: list, asks: list, seq: int | None) -> str | None:
        """Replace the book; a crossed snapshot is refused and the old book stays."""
        sides = [self.read(x) for x in (bids, asks)]
        if None in sides:
            return "scale mismatch"
        new = Book(self.depth)
        for side, levels in zip((new.bids, new.asks), sides):
            for p, q, *text in levels:
                side.set(p, (q, *text) if q > 0 else None)
        new.trim()
        if new.crossed():
            return "crossed snapshot"
        self.bids, self.asks, self.seq, self.bridged, self.validity = new.bids, new.asks, seq, False, "valid"
        return None

    def change(self, bids: list, asks: list) -> str | None:
        """Apply a message as a whole; one that would cross the book changes nothing."""
        sides = [self.read(x) for x in (bids, asks)]
        if None in sides:
            return "scale mismatch"
        undo = []
        for side, levels in zip((self.bids, self.asks), sides):
            for p, q, *text in levels:
                undo.append((side, p, side.levels.get(p)))
                side.set(p, (q, *text) if q else None)
        if self.crossed():
            for side, p, old in reversed(undo):
                side.set(p, old)
            return "crossed"
        self.trim()
        return None

    def checksum(self, depth: int = 10) -> int:
        """CRC-32 over the best asks and then the best bids, digits as written without leading zeros."""
        bare = lambda text: text.replace(".", "").lstrip("0") or "0"
        text = "".join(bare(x) for side in (self.asks, self.bids) for p in side.from_best()[:depth] for x in side.levels[p][1:])
        return zlib.crc32(text.encode())


def continuity(rule: str, book: Book, first: int | None, last: int | None, previous: int | None) -> str:
    """apply, skip or gap. spanning: an update starts by the next number; previous: the first update must
    span the snapshot's number, later ones name the one before; plus_one: numbers rise by one;
    at_most_next: as spanning; drop_stale: only old ones are dropped; replace and checksum: all are taken."""
    if rule in ("replace", "checksum") or book.seq is None or last is None:
        return "apply"
    if last <= book.seq:
        return "skip"
    if rule == "plus_one":
        return "apply" if last == book.seq + 1 else "gap"
    if rule == "previous":
        if not book.bridged and first is not None:
            return "apply" if first <= book.seq else "gap"
        return "apply" if previous == book.seq else "gap"
    if rule in ("spanning", "at_most_next"):
        return "apply" if first is not None and first <= book.seq + 1 else "gap"
    return "apply"


def _levels(row: dict) -> list[list]:
    return [[tuple(x.values() if isinstance(x, dict) else x) for x in (row[s] if row[s] is not None else ())] for s in ("bids", "asks")]


def _wait(book: Book, row: dict) -> str:
    """Let a delta wait, if with it they aren't too many, too large or too far apart: all are lost otherwise. ``held``
    has the bytes that wait and the first and last time."""
    size, *times = book.held if book.waiting else (0, None, None)
    times = [t for t in (*times, row.get("mono_ns")) if t is not None]
    size += row.get("bytes_len") or 0
    span = max(times) - min(times) if times else 0
    if len(book.waiting) >= MOST_BUFFERED or size > MOST_BYTES or span > MOST_SPAN_NS:
        book.waiting.clear()
        book.validity = "invalid"
        return "buffer overflow"
    book.held = (size, min(times), max(times)) if times else (size, None, None)
    book.waiting.append({k: row.get(k) for k in (*UPDATE[3:6], "checksum")} | dict(zip(("bids", "asks"), _levels(row))))
    return "buffered"


def _start(book: Book, row: dict, rule: str, lenient: bool) -> str:
    """Take a snapshot and the deltas that wait for it. One older than they reach back is refused, as is
    one that leaves a hole before the first delta over it; that hole makes the book invalid."""
    last, waiting = row["last_seq"], book.waiting
    if waiting and last is not None and rule == "spanning":
        if last < waiting[0]["first_seq"]:
            return "snapshot too old"
        waiting = [x for x in waiting if x["last_seq"] > last]
        if waiting and waiting[0]["first_seq"] > last:
            book.waiting, book.validity = [], "invalid"
            return "no bridge"
    failed = book.snapshot(*_levels(row), last)
    if failed:
        return failed
    book.waiting = []
    if rule == "checksum" and row.get("checksum") is not None and book.checksum() != row["checksum"]:
        book.validity = "invalid"
        return "checksum"
    for held in waiting:
        reason = step(book, held | {"snapshot": False}, rule, lenient)
        if reason not in ("", "stale"):
            return reason
    return ""


def step(book: Book, row: dict, rule: str, lenient: bool) -> str:
    """Take one update; the reason is empty where it was applied. A gap makes the book invalid until the
    next snapshot; lenient: failed updates are passed over and the book stays."""
    if row["snapshot"]:
        return _start(book, row, rule, lenient)
    if book.validity != "valid":
        return _wait(book, row) if rule in BUFFERED and row["last_seq"] is not None and (row["first_seq"] is not None or rule == "plus_one") else "no snapshot"
    what = continuity(rule, book, row["first_seq"], row["last_seq"], row["previous_seq"])
    if what == "skip":
        return "stale"
    if what == "gap":
        if not lenient:
            book.validity = "invalid"
        return "gap"
    failed = book.change(*_levels(row))
    if failed:
        return failed
    book.seq, book.bridged = row["last_seq"] if row["last_seq"] is not None else book.seq, True
    if rule == "checksum" and row.get("checksum") is not None and book.checksum() != row["checksum"]:
        if not lenient:
            book.validity = "invalid"
        return "checksum"
    return ""


def _report(name: str, row: dict, book: Book, reason: str) -> tuple:
    good = book.validity == "valid"
    bid, ask = (float(x) if good and x is not None else None for x in (book.bids.best(), book.asks.best()))
    return name, row["ord"], book.seq, book.validity, reason, bid, ask, len(book.bids.prices) + len(book.asks.prices)


def _rows(batch: pd.DataFrame) -> Iterator[dict]:
    numbers = ("first_seq", "last_seq", "previous_seq", *OPTIONAL)
    whole = [[None if lost else int(x) for x, lost in zip(batch[k].tolist(), batch[k].isna())] for k in numbers]
    for r, *values in zip(batch.to_dict("records"), *whole):
        yield r | dict(zip(numbers, values))


def _checked(updates: DataFrame, rule: str, *more: str) -> DataFrame:
    if rule not in RULES:
        raise ValueError(rule)
    optional = [(F.col(c) if c in updates.columns else F.lit(None)).cast("long").alias(c) for c in OPTIONAL]
    return updates.select(*more, *UPDATE, *optional).where("book is not null")


STORE = "spark.sql.streaming.stateStore.providerClass"
NAMES = [x.split()[0] for x in OUT.split(", ")]
KINDS = {"seq": "Int64", "best_bid": float, "best_ask": float}


_NONE = -(1 << 62)
_FOLDED = f"session string, {OUT}, epoch long, waiting long, waiting_first long, waiting_last long, start_seq long"
_WAITING = ("waiting", "waiting_first", "waiting_last", "start_seq")


def _epochs(rows: DataFrame, keys: list[str], depth: int, scales: tuple[int | None, int | None], block: int) -> DataFrame:
    """``epoch`` beside the updates: the ``ord`` of the last snapshot up to each one that any book would take. Behind it
    nothing depends on what was before, but for deltas that waited for it."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys, "ord").dtypes)

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [Book(depth, *scales).snapshot(*_levels(r), None) is None for r in batch.to_dict("records")]
            yield batch[[*keys, "ord"]][good].assign(epoch=batch["ord"][good])

    starts = rows.where("snapshot").select(*keys, "ord", "bids", "asks").mapInPandas(taken, f"{kinds}, epoch long")
    return as_of(rows, starts, keys, ["epoch"], time="ord", block=block).withColumn("epoch", F.coalesce("epoch", F.lit(_NONE)))


def _folded(rows: DataFrame, rule: str, depth: int, lenient: bool, scales: tuple[int | None, int | None]) -> DataFrame:
    """Every epoch by itself, a row an update; ``waiting`` on an epoch's last row: deltas that wait there, the first one's
    first and the largest last number of them, and that of the snapshot that the epoch starts with. Rows have a session
    and in ``breaks`` how often its numbers had broken by then; ``broken`` where they did just there."""
    columns = ["session", *NAMES, "epoch", *_WAITING]
    kinds = KINDS | dict.fromkeys(_WAITING, "Int64")

    def end(book: Book, start: int | None) -> tuple:
        held = book.waiting
        return (len(held), held[0]["first_seq"], max(x["last_seq"] for x in held), start) if held else (0, None, None, start)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, book, breaks, last, start = None, None, None, None, None
        for batch in batches:
            out = []
            for row in _rows(batch):
                key = row["session"], row["book"], row["epoch"]
                if key != at:
                    if last is not None:
                        out.append((*last, *end(book, start)))
                    at, book, breaks = key, Book(depth, *scales), row["breaks"] - row["broken"]
                    start = row["last_seq"] if row["snapshot"] else None
                elif last is not None:
                    out.append((*last, None, None, None, None))
                if row["breaks"] > breaks:
                    book.validity = "invalid"
                breaks = row["breaks"]
                reason = "gap" if row["broken"] and not row["snapshot"] else step(book, row, rule, lenient)
                last = (row["session"], *_report(row["book"], row, book, reason), row["epoch"])
            yield pd.DataFrame(out, columns=columns).astype(kinds)
        if last is not None:
            yield pd.DataFrame([(*last, *end(book, start))], columns=columns).astype(kinds)

    keys = ["session", "book", "epoch"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "ord").mapInPandas(run, _FOLDED)


def _stored(df: DataFrame) -> DataFrame:
    path = work_folder(df.sparkSession, "books")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _joined_epochs(folded: DataFrame, rule: str) -> DataFrame:
    """(session, book, epoch, into): epochs that must be folded together with one before them, as deltas wait
    at its end that their snapshot doesn't make stale, and those they must be folded with. All stale ones are passed
    over, and the snapshot is taken as if none had waited."""
    ends = folded.where("waiting is not null").select("session", "book", "epoch", *_WAITING)
    prior = running_last(ends, ["session", "book"], [], {"__prior": F.struct(*_WAITING[:3])}, time="epoch", block=1 << 40, before=True)
    stale = F.col("__prior.waiting_last") <= F.col("start_seq")
    if rule == "spanning":  # an older snapshot is refused
        stale &= F.col("__prior.waiting_first") <= F.col("start_seq")
    clean = F.col("__prior").isNull() | (F.col("__prior.waiting") == 0) | F.coalesce(stale, F.lit(False))
    heads = running_last(prior, ["session", "book"], [], {"into": F.when(clean, F.col("epoch"))}, time="epoch", block=1 << 40)
    joined = heads.where("into <> epoch").select("session", "book", "epoch", "into")
    return joined.unionByName(joined.select("session", "book", F.col("into").alias("epoch"), "into").distinct())


def _fold(rows: DataFrame, rule: str, depth: int, lenient: bool, scales: tuple[int | None, int | None]) -> DataFrame:
    """Epochs apart; where deltas wait at an epoch's end, it's folded again with the next one, until none do."""
    folded = _folded(rows, rule, depth, lenient, scales)
    if rule not in BUFFERED:
        return folded
    folded, names = _stored(folded), ["session", "book", "epoch"]
    while True:
        again = _stored(_joined_epochs(folded, rule))
        if again.isEmpty():
            return folded
        rows = _stored(rows.join(again, names, "left").withColumn("epoch", F.coalesce("into", "epoch")).drop("into"))
        anew = _folded(rows.join(again.select("session", "book", F.col("into").alias("epoch")).distinct(), names, "left_semi"), rule, depth, lenient, scales)
        folded = _stored(folded.join(again, names, "left_anti").unionByName(anew))


def fold_books(updates: DataFrame, *, rule: str = "spanning", depth: int = 0, lenient: bool = False, price_scale: int | None = None, quantity_scale: int | None = None, block: int = 100_000) -> DataFrame:
    """One row an update: the book's state after it. Updates (UPDATE columns, ``checksum`` if there is
    one; bids and asks are arrays of (price, quantity), as text or numbers) are taken in the order of
    ``ord``; rows without a book are left out. Under ``spanning``, ``previous`` and ``plus_one`` deltas
    without a valid book wait for its next snapshot. Scales: digits that a level may have.

    A book's line is cut at the snapshots it can take, so one busy book is as many tasks as it has of them.
    """
    scales = price_scale, quantity_scale
    rows = _epochs(_checked(updates, rule), ["book"], depth, scales, block)
    rows = rows.withColumns({"session": F.lit(""), "breaks": F.lit(0).cast("long"), "broken": F.lit(0).cast("long")})
    return _fold(rows, rule, depth, lenient, scales).select(*NAMES)


def fold_sessions(updates: DataFrame, *, depth: int = 0, block: int = 100_000) -> DataFrame:
    """As ``fold_books`` where one sequence (``last_seq``) runs through all books of a ``session``: a break makes all
    of them invalid. Breaks are found and counted in blocks of the session's line; each book then needs only their count."""
    rows = _checked(updates, "replace", "session")
    kind = dict(rows.dtypes)["session"]
    rows = running_last(rows, ["session"], [], {"__prior": F.struct("last_seq")}, time="ord", block=block, before=True)
    before = F.col("__prior.last_seq")
    broken = F.coalesce(before.isNotNull() & ~F.col("last_seq").eqNullSafe(before + 1), F.lit(False)).cast("long")
    rows = running_sums(rows.withColumn("broken", broken), ["session"], [], {"breaks": F.col("broken")}, time="ord", block=block)
    rows = _epochs(rows.drop("__prior"), ["session", "book"], depth, (None, None), block).withColumn("session", F.col("session").cast("string"))
    out = _fold(rows, "replace", depth, False, (None, None))
    return out.select(F.col("session").cast(kind).alias("session"), *NAMES)


class BookProcessor(StatefulProcessor):
    """A book's state on a stream: one entry a level, one a waiting delta, and a head. A micro-batch writes the levels
    it changed; deltas are only written while they wait."""

    def __init__(self, rule: str, depth: int, lenient: bool, scales: tuple[int | None, int | None]) -> None:
        self.rule, self.lenient, self.new = rule, lenient, lambda: Book(depth, *scales)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "bid boolean, price string", "price string, quantity string")
        self.head = handle.getValueState("head", "seq long, bridged boolean, validity string, bytes long, first long, last long")
        self.deltas = handle.getListState("waiting", "delta string")

    def _load(self) -> Book:
        book = self.new()
        if self.head.exists():
            seq, book.bridged, book.validity, size, first, last = self.head.get()
            book.seq, book.held = seq, (size, first, last)
            for (bid, _), (price, quantity) in self.levels.iterator():
                (book.bids if bid else book.asks).set(Decimal(price), (Decimal(quantity), price, quantity))
            book.waiting = [json.loads(x[0]) for x in self.deltas.get()]
        return book

    @staticmethod
    def _entries(book: Book) -> dict[tuple[bool, str], tuple[str, str]]:
        return {(bid, str(p.normalize())): side.levels[p][1:] for bid, side in ((True, book.bids), (False, book.asks)) for p in side.prices}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        book = self._load()
        before, waited = self._entries(book), len(book.waiting)
        now = pd.concat(list(rows)).sort_values("ord")  # one book's rows of one micro-batch
        out = [_report(key[0], row, book, step(book, row, self.rule, self.lenient)) for row in _rows(now)]
        after = self._entries(book)
        for place in before.keys() - after.keys():
            self.levels.removeKey(place)
        for place, level in after.items():
            if before.get(place) != level:
                self.levels.updateValue(place, level)
        if waited or book.waiting:
            self.deltas.clear()
            if book.waiting:
                self.deltas.put([(json.dumps(x),) for x in book.waiting])
        self.head.update((book.seq, book.bridged, book.validity, *book.held))
        yield pd.DataFrame(out, columns=NAMES).astype(KINDS)

    def close(self) -> None:
        pass


def stream_books(updates: DataFrame, *, rule: str = "spanning", depth: int = 0, lenient: bool = False, price_scale: int | None = None, quantity_scale: int | None = None) -> DataFrame:
    """The fold over a stream: each book's state is kept between micro-batches; updates of one batch
    are taken in the order of ``ord``. State by level needs the RocksDB store, which is set for the session."""
    updates.sparkSession.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    processor = BookProcessor(rule, depth, lenient, (price_scale, quantity_scale))
    return _checked(updates, rule).groupBy("book").transformWithStateInPandas(processor, OUT, "Append", "None")
