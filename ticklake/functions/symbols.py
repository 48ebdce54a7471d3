"""Names of instruments: base asset, market kind, display pair, candle intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quote currencies that end a name, assets of the usual order, and names that tell a market's kind
#: (fixed values).
QUOTES = ("USDT", "USDC", "USD", "EUR", "BTC", "ETH", "BNB")
ASSET_ORDER = ("BTC", "ETH", "SOL", "XRP", "BNB")
PERPETUAL_VENUES = ("deribit", "binance-usdm", "binance-coinm", "okx-swap", "bybit-linear")
SPOT_VENUES = ("gemini", "bitstamp", "bitfinex", "coinbase-spot", "kraken-spot", "binance-spot", "bybit-spot", "okx-spot")
_QUOTE = f"(?:{'|'.join(QUOTES)})"


def base_asset(symbol: Column) -> Column:
    """BTC of BTCUSDT, tBTCUSD, BTC-USD-SWAP, XBT/USD: the name before its quote currency, of two to six
    characters; else what BTC, XBT and ETH names start with; else null."""
    s = F.regexp_replace(F.upper(F.trim(symbol)), "^T(?=[A-Z])", "")
    s = F.regexp_replace(F.regexp_replace(s, "[-_/]", ""), "(?:PERPETUAL|PERP|SWAP|SPOT)$", "")
    base = F.regexp_extract(s, f"^(.+){_QUOTE}$", 1)
    named = F.when(base == "XBT", "BTC").when(F.length(base).between(2, 6), base)
    return F.coalesce(named, F.when(s.rlike("^(?:XBT|BTC)"), "BTC").when(s.startswith("ETH"), "ETH"))


def market_kind(venue: Column, symbol: Column) -> Column:
    """perp, spot or other: by the symbol first, then by the venue."""
    v, s = F.lower(F.coalesce(venue, F.lit(""))), F.upper(F.coalesce(symbol, F.lit("")))
    perpetual = s.rlike("PERPETUAL|PERP|SWAP") | v.isin(*PERPETUAL_VENUES) | v.rlike("usdm|coinm|swap|linear|perp|futures|inverse")
    return F.when(perpetual, "perp").when(v.isin(*SPOT_VENUES) | v.contains("spot"), "spot").otherwise("other")


def display_pair(symbol: Column) -> Column:
    """BTC/USDT of BTCUSDT, btc-usdt and BTC_USDT; other names get their first dash as a slash."""
    pair = f"(?i)^([A-Z0-9]+)[-_/]?({_QUOTE})$"
    joined = F.concat_ws("/", F.upper(F.regexp_extract(symbol, pair, 1)), F.upper(F.regexp_extract(symbol, pair, 2)))
    return F.when(symbol.rlike(pair), joined).otherwise(F.regexp_replace(symbol, "^([^-]*)-", "$1/"))


def asset_rank(asset: Column) -> Column:
    """Place of an asset in lists: the usual ones first, then by name."""
    at = F.array_position(F.array(*[F.lit(x) for x in ASSET_ORDER]), asset).cast("int")
    return F.when(at > 0, at - 1).otherwise(50)


#: Nanoseconds of candle intervals (fixed values).
INTERVALS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "1d": 86_400}


def interval_ns(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in INTERVALS.items() for x in (k, v * 1_000_000_000)])
    return known[F.lower(name)]


def rfc3339_ns(text: Column) -> Column:
    """Nanoseconds of an RFC 3339 time, all nine digits kept."""
    digits = F.rpad(F.regexp_extract(text, r"\.([0-9]+)", 1), 9, "0")
    whole = F.regexp_replace(text, r"\.[0-9]+", "")
    return F.unix_micros(F.try_to_timestamp(whole)) * 1000 + F.coalesce(digits.try_cast("long"), F.lit(0))
