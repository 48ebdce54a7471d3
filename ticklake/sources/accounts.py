"""Account messages (balances, orders, fills) and instrument lists of venues: JSON text in, rows out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decimals import parse_decimal
from .venues import KEYED, ms

DECIMAL = "decimal(38,18)"
FIELDS = {
    "kind": "string", "asset": "string", "free": DECIMAL, "locked": DECIMAL, "delta": DECIMAL, "symbol": "string", "client_order_id": "string", "order_id": "string", "execution_type": "string", "status": "string",
    "price": DECIMAL, "quantity": DECIMAL, "filled": DECIMAL, "fee": DECIMAL, "trade_id": "string", "exchange_ts_ns": "bigint",
}
ROWS = f"array<struct<{', '.join(f'{n}: {t}' for n, t in FIELDS.items())}>>"
MAPS = f"array<{KEYED}>"


def _row(kind: str, when: Column, **fields: Column) -> Column:
    fields = {"kind": F.lit(kind), **fields}
    read = lambda n, t: parse_decimal(fields[n].cast("string"), exponent=True) if t == DECIMAL else fields[n].cast(t)
    cols = [(read(n, t) if n in fields else F.lit(None).cast(t)).alias(n) for n, t in FIELDS.items()]
    return F.when(F.coalesce(when, F.lit(False)), F.struct(*cols))


def _each(rows: Column, rule, when: Column) -> Column:
    none = F.array().cast(ROWS)
    return F.when(F.coalesce(when, F.lit(False)), F.coalesce(F.transform(rows, rule), none)).otherwise(none)


def _some(text: Column) -> Column:
    return F.when(text != "", text)


def binance(raw: Column) -> Column:
    """A report of a trade gives the order and its fill."""
    j = F.from_json(raw, KEYED)
    e, at = j["e"], ms(j["E"])
    report = e == "executionReport"
    own = dict(symbol=j["s"], order_id=j["i"], exchange_ts_ns=at)
    return F.concat(
        _each(F.from_json(j["B"], MAPS), lambda b: _row("balance", b["a"].isNotNull(), asset=b["a"], free=F.coalesce(b["f"], F.lit("0")), locked=F.coalesce(b["l"], F.lit("0")), exchange_ts_ns=at), e == "outboundAccountPosition"),
        F.array(
            _row("balance_delta", e == "balanceUpdate", asset=j["a"], delta=j["d"], exchange_ts_ns=F.coalesce(ms(j["T"]), at)),
            _row("order", report, client_order_id=j["c"], execution_type=j["x"], status=j["X"], price=j["p"], quantity=j["q"], filled=j["z"], **own),
            _row("fill", report & (j["x"] == "TRADE"), price=j["L"], quantity=j["l"], fee=j["n"], trade_id=j["t"], **own),
        ),
    )


def bybit(raw: Column) -> Column:
    m = F.from_json(raw, f"struct<topic:string,ts:string,data:{MAPS}>")
    topic = m["topic"]
    coins = F.flatten(F.transform(m["data"], lambda d: F.coalesce(F.from_json(d["coin"], MAPS), F.array().cast(MAPS))))
    return F.concat(
        _each(coins, lambda c: _row("balance", c["coin"].isNotNull(), asset=c["coin"], free=F.coalesce(_some(c["availableToWithdraw"]), _some(c["walletBalance"]), F.lit("0")), locked=F.coalesce(_some(c["locked"]), F.lit("0")), exchange_ts_ns=ms(m["ts"])), topic == "wallet"),
        _each(m["data"], lambda d: _row("order", d["symbol"].isNotNull(), symbol=d["symbol"], order_id=d["orderId"], client_order_id=d["orderLinkId"], status=d["orderStatus"], price=_some(d["price"]), quantity=_some(d["qty"]), filled=_some(d["cumExecQty"]), exchange_ts_ns=ms(d["updatedTime"])), topic == "order"),
        _each(m["data"], lambda d: _row("fill", d["symbol"].isNotNull(), symbol=d["symbol"], order_id=d["orderId"], trade_id=d["execId"], price=d["execPrice"], quantity=d["execQty"], fee=_some(d["execFee"]), exchange_ts_ns=ms(d["execTime"])), topic == "execution"),
    )


def okx(raw: Column) -> Column:
    m = F.from_json(raw, f"struct<arg:struct<channel:string>,data:{MAPS}>")
    channel = m["arg"]["channel"]
    own = lambda d: dict(symbol=d["instId"], order_id=d["ordId"], exchange_ts_ns=ms(d["uTime"]))
    details = F.flatten(F.transform(m["data"], lambda d: F.transform(F.coalesce(F.from_json(d["details"], MAPS), F.array().cast(MAPS)), lambda x: F.map_concat(x, F.create_map(F.lit("uTime"), F.coalesce(d["uTime"], F.lit("")))))))
    filled = F.filter(m["data"], lambda d: F.coalesce(d["fillSz"], F.lit("0")).try_cast("double") > 0)
    return F.concat(
        _each(details, lambda x: _row("balance", x["ccy"].isNotNull(), asset=x["ccy"], free=F.coalesce(_some(x["availBal"]), F.lit("0")), locked=F.coalesce(_some(x["frozenBal"]), F.lit("0")), exchange_ts_ns=ms(x["uTime"])), channel == "account"),
        _each(m["data"], lambda d: _row("order", d["ordId"].isNotNull(), client_order_id=_some(d["clOrdId"]), status=d["state"], price=_some(d["px"]), quantity=_some(d["sz"]), filled=_some(d["accFillSz"]), **own(d)), channel == "orders"),
        _each(filled, lambda d: _row("fill", F.lit(True), price=d["fillPx"], quantity=d["fillSz"], fee=_some(d["fee"]), trade_id=_some(d["tradeId"]), **own(d)), channel == "orders"),
    )


ACCOUNTS: dict[str, Callable[[Column], Column]] = {"binance": binance, "bybit": bybit, "okx": okx}


def account_events(raw: DataFrame, venue: str, *, value: str = "value") -> DataFrame:
    """Account rows of a venue's frames with the frame's other columns; other frames give none."""
    rest = [c for c in raw.columns if c != value]
    rows = raw.select(*rest, F.posexplode(F.array_compact(F.coalesce(ACCOUNTS[venue](F.col(value)), F.array().cast(ROWS)))).alias("event_index", "__e"))
    return rows.select(*rest, "event_index", "__e.*")


#: Where a venue's REST answer has its list, and a row's symbol, base, quote, price step, quantity step and state (fixed values).
INSTRUMENTS = {
    "binance": ("symbols", ("symbol", "baseAsset", "quoteAsset", None, None, "status"), ("TRADING",)),
    "okx": ("data", ("instId", "baseCcy", "quoteCcy", "tickSz", "lotSz", "state"), ("live",)),
    "bybit": ("result.list", ("symbol", "baseCoin", "quoteCoin", None, None, "status"), ("Trading",)),
    "coinbase": (None, ("id", "base_currency", "quote_currency", "quote_increment", "base_increment", "status"), ("online",)),
}


def instruments_of(raw: DataFrame, venue: str, *, value: str = "value") -> DataFrame:
    """Catalog rows (symbol, base, quote, price_step, quantity_step, active) of captured REST answers."""
    path, names, active = INSTRUMENTS[venue]
    body = F.get_json_object(value, f"$.{path}") if path else F.col(value)
    rows = raw.select(F.explode(F.from_json(body, MAPS)).alias("r"))
    r = F.col("r")
    symbol, base, quote, tick, lot, state = (r[n] if n else F.lit(None).cast("string") for n in names)
    if venue in ("binance", "bybit"):  # steps lie in lists of filters
        steps = {"binance": ("filters", "PRICE_FILTER", "LOT_SIZE"), "bybit": (None, "priceFilter", "lotSizeFilter")}[venue]
        if steps[0]:
            found = lambda kind, name: F.get(F.filter(F.from_json(r[steps[0]], MAPS), lambda f: f["filterType"] == kind), F.lit(0))[name]
            tick, lot = found(steps[1], "tickSize"), found(steps[2], "stepSize")
        else:
            tick, lot = F.from_json(r[steps[1]], KEYED)["tickSize"], F.coalesce(F.from_json(r[steps[2]], KEYED)["qtyStep"], F.from_json(r[steps[2]], KEYED)["basePrecision"])
    step = lambda c: parse_decimal(c, exponent=True)
    return rows.select(symbol.alias("symbol"), base.alias("base"), quote.alias("quote"), step(tick).alias("price_step"), step(lot).alias("quantity_step"), F.coalesce(state.isin(*active), F.lit(False)).alias("active")).where("symbol is not null")
