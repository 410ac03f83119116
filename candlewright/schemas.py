"""Schemas of the engine's tables and streams, as DDL."""

TICK = "seq bigint, symbol string, price decimal(38,18), quantity decimal(38,18), event_ms bigint, arrival_ms bigint, record_id string"
CANDLE = (
    "symbol_id bigint, interval string, bucket_time timestamp_ntz, open decimal(18,6), high decimal(18,6), "
    "low decimal(18,6), close decimal(18,6), volume bigint, updated_at timestamp_ntz, version bigint"
)
KLINE = (
    "symbol string, interval string, start_s bigint, close_s bigint, open decimal(18,6), high decimal(18,6), "
    "low decimal(18,6), close decimal(18,6), volume decimal(28,8), trades bigint, closed boolean"
)
TICKER = "symbol string, price decimal(38,18), volume decimal(38,18), event_ms bigint"
EXCHANGE_KLINE = (
    "open_ms bigint, open decimal(38,18), high decimal(38,18), low decimal(38,18), close decimal(38,18), volume decimal(38,18), "
    "close_ms bigint, quote_volume decimal(38,18), trades int, taker_buy_base decimal(38,18), taker_buy_quote decimal(38,18)"
)
AUDIT = "symbol_id bigint, interval_type string, bucket_time timestamp_ntz, reason string, expected_close decimal(18,6), actual_close decimal(18,6), created_at timestamp_ntz"
SYMBOL = (
    "id bigint, symbol string, exchange string, name string, active boolean, market_type string, provider_symbol string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
COMMAND = "seq bigint, session_id string, command string, symbol string"
METRIC = "ts timestamp_ntz, application string, metric string, tags map<string,string>, value double"
PENDING = "record_id string, consumer string, last_delivery_ms bigint"
