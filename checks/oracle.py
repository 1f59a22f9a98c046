"""The registered queries as plain SQL over the same parquet tables."""

from __future__ import annotations

from ledgerlens.functions.text import URL_PATTERN
from ledgerlens.sources.testdata import LATE_CUTOFF

DAY = "date_diff('day', DATE '1970-01-01', CAST({0} AS DATE))"

# The five report tables, and what most reports start from: enriched trades ``e``,
# the block window ``w`` and the trades inside it.
TABLES = f"""
contracts AS (
  SELECT p_partkey AS contract_address, p_type AS contract_type, p_name AS contract_name,
         p_brand AS contract_symbol, 9131 + p_partkey AS init_block
  FROM part WHERE p_size > 2),
blocks AS (
  SELECT DISTINCT {DAY.format('l_shipdate')} AS block_number,
         {DAY.format('l_shipdate')} * 86400 AS timestamp_of_block,
         CAST(l_shipdate AS DATE) AS date FROM lineitem),
blocks_orders AS (
  SELECT DISTINCT {DAY.format('o_orderdate')} AS block_number,
         {DAY.format('o_orderdate')} * 86400 AS timestamp_of_block,
         CAST(o_orderdate AS DATE) AS date FROM orders),
rates AS (
  SELECT date, CAST(1000 + block_number % 997 AS DOUBLE) AS eth_usd_rate FROM blocks_orders),
trades AS (
  SELECT 'T' || l_orderkey AS transaction_hash, {DAY.format('l_shipdate')} AS block_number,
         l_partkey AS contract_address, l_suppkey AS token_id, 'S' || l_suppkey AS seller,
         'C' || o_custkey AS buyer, l_returnflag AS currency_address,
         l_extendedprice AS price_value, o_orderpriority AS market
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
transfers AS (
  SELECT transaction_hash, contract_address, token_id, block_number,
         seller AS from_address, buyer AS to_address FROM trades),
priced AS (
  SELECT t.*, b.date, r.eth_usd_rate, t.price_value * r.eth_usd_rate AS price_usd
  FROM trades t JOIN blocks b USING (block_number) JOIN rates r USING (date)
  WHERE t.currency_address IN ('A', 'N')),
e AS (SELECT p.*, c.contract_name, c.contract_type, c.contract_symbol, c.init_block
      FROM priced p JOIN contracts c USING (contract_address)),
w AS (SELECT min(block_number) AS lo, max(block_number) AS hi FROM blocks
      WHERE date BETWEEN DATE '1995-03-06' AND DATE '1995-03-12'),
e_week AS (SELECT e.* FROM e, w WHERE e.block_number BETWEEN w.lo AND w.hi),
t_week AS (SELECT t.* FROM transfers t, w WHERE t.block_number BETWEEN w.lo AND w.hi)
"""

DEC = "CAST({0} AS DECIMAL(38,4))"
SUM_ETH = "sum(CAST(price_value AS DECIMAL(38,4)))"
SUM_USD = "sum(CAST(price_usd AS DECIMAL(38,4)))"
AVG_ETH = f"CAST({SUM_ETH} AS DOUBLE) / count(price_value)"
AVG_USD = f"CAST({SUM_USD} AS DOUBLE) / count(price_usd)"


def money(expression: str, digits: int = 2) -> str:
    return f"CAST(CAST({expression} AS DECIMAL(38,{digits})) AS DOUBLE)"


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([TABLES.strip(), *ctes]) + "\n" + body.strip()


def ordered(metric: str, ties: str, k: int | None = 10) -> str:
    limit = f" LIMIT {k}" if k else ""
    return f"ORDER BY {metric} DESC NULLS FIRST, {ties}{limit}"


E_COLUMNS = """transaction_hash, block_number, contract_address, token_id, seller, buyer,
currency_address, price_value, market, eth_usd_rate, price_usd, contract_name, contract_type,
contract_symbol, init_block, CAST(date AS VARCHAR) AS date"""

TRADE_COLUMNS = """transaction_hash, block_number, contract_address, token_id, seller, buyer,
currency_address, price_value, market"""

ORACLE: dict[str, str] = {
    "enrich_trades": sql(f"SELECT {E_COLUMNS} FROM e"),
    "enrich_trades_by_range": sql(f"SELECT {E_COLUMNS} FROM e"),
    "week_window": sql("SELECT lo AS start_block, hi AS end_block FROM w"),
    "week_trades": sql(f"SELECT {E_COLUMNS} FROM e_week"),
    "week_transfers": sql("SELECT * FROM t_week"),
    "cutoff_block": sql("""
        SELECT block_number, CAST(date AS VARCHAR) AS date FROM blocks
        WHERE date <= DATE '1995-03-06' ORDER BY blocks.date DESC LIMIT 1"""),
}

for _scope, _e in (("week", "e_week"), ("all", "e")):
    ORACLE[f"volume_collections_{_scope}"] = sql(f"""
        SELECT contract_address, contract_name, {money(SUM_USD, 4)} AS price_usd
        FROM {_e} GROUP BY contract_address, contract_name
        {ordered('price_usd', 'contract_address')}""")
    ORACLE[f"volume_markets_{_scope}"] = sql(f"""
        SELECT market, {money(SUM_USD)} AS price_usd FROM {_e} GROUP BY market""")
    ORACLE[f"trades_collections_{_scope}"] = sql(f"""
        SELECT contract_address, contract_name, count(*) AS count
        FROM {_e} GROUP BY contract_address, contract_name
        {ordered('count', 'contract_address')}""")
    ORACLE[f"trades_tokens_{_scope}"] = sql(f"""
        SELECT contract_address, token_id, contract_name, count(*) AS count
        FROM {_e} GROUP BY contract_address, token_id, contract_name
        {ordered('count', 'contract_address, token_id')}""")
    for _name, _keys in (("collections", "contract_address"), ("tokens", "contract_address, token_id")):
        ORACLE[f"price_stats_{_name}_{_scope}"] = sql(f"""
            SELECT {_keys}, contract_name, {AVG_ETH} AS price_value_avg,
                   max(price_value) AS price_value_max, min(price_value) AS price_value_min,
                   count(*) AS count
            FROM {_e} GROUP BY {_keys}, contract_name
            {ordered('price_value_avg', _keys)}""")

ORACLE["volume_collections_ranked"] = sql(f"""
    SELECT contract_address, contract_name, {money(SUM_USD, 4)} AS price_usd
    FROM e GROUP BY contract_address, contract_name""")


def _extremes(scope: str, e: str) -> str:
    tokens = f"""(SELECT contract_address, token_id, contract_name, max(price_value) AS top,
        {AVG_ETH} AS mean FROM {e} GROUP BY contract_address, token_id, contract_name)"""
    parts = []
    for name, value, where, order in (
        ("highest_max", "top", "", "top DESC NULLS FIRST, contract_address, token_id"),
        ("lowest_max", "top", "WHERE top > 0", "top, contract_address DESC, token_id DESC"),
        ("highest_avg", "mean", "", "mean DESC NULLS FIRST, contract_address, token_id"),
        ("lowest_avg", "mean", "", "mean NULLS LAST, contract_address DESC, token_id DESC"),
    ):
        parts.append(f"""(SELECT '{scope}' AS scope, '{name}' AS extreme, contract_address, token_id,
            contract_name, {value} AS price FROM {tokens} {where} ORDER BY {order} LIMIT 1)""")
    return "\nUNION ALL\n".join(parts)


ORACLE["price_extremes"] = sql(
    _extremes("week", "e_week") + "\nUNION ALL\n" + _extremes("all", "e")
)

for _function in ("max", "min"):
    ORACLE[f"token_{_function}_all_columns"] = sql(
        "SELECT contract_address, token_id, " + ", ".join(
            f"{_function}({c}) AS {c}" for c in (
                "contract_name", "block_number", "transaction_hash", "currency_address",
                "price_value", "eth_usd_rate", "price_usd", "seller", "buyer", "market",
            )
        ) + f""", {_function}(CAST(date AS VARCHAR)) AS date
        FROM e GROUP BY contract_address, token_id"""
    )
ORACLE["token_sum_all_columns"] = sql(f"""
    SELECT contract_address, token_id, CAST(sum(block_number) AS BIGINT) AS block_number,
           CAST({SUM_ETH} AS DOUBLE) AS price_value, CAST({SUM_USD} AS DOUBLE) AS price_usd,
           CAST(sum(CAST(eth_usd_rate AS DECIMAL(38,4))) AS DOUBLE) AS eth_usd_rate
    FROM e GROUP BY contract_address, token_id""")
ORACLE["token_price_summary"] = sql(f"""
    SELECT contract_address, token_id, min(price_value) AS min_price_value,
           max(price_value) AS max_price_value, {AVG_ETH} AS avg_price_value, count(*) AS count
    FROM e GROUP BY contract_address, token_id""")

# The literal definition: one row per token, weighted by its transfers.
_CAP = f"""
    SELECT {money("sum(CAST(n * eth_avg AS DECIMAL(38,8)))")} AS market_cap_eth,
           {money("sum(CAST(n * usd_avg AS DECIMAL(38,8)))")} AS market_cap_usd
    FROM weights JOIN prices USING (contract_address)"""
_PRICES = f"""prices AS (SELECT contract_address, {AVG_ETH} AS eth_avg, {AVG_USD} AS usd_avg
    FROM e GROUP BY contract_address)"""
ORACLE["market_cap"] = sql(_CAP, _PRICES, """weights AS (
    SELECT contract_address, count(*) AS n FROM transfers GROUP BY contract_address)""")
ORACLE["market_cap_tokens"] = sql(_CAP, _PRICES, """weights AS (
    SELECT contract_address, count(DISTINCT token_id) AS n FROM transfers
    GROUP BY contract_address)""")


def both(body: str) -> str:
    """A query template over {scope}, {e} and {t}, for the week and for all time."""
    return sql("\nUNION ALL\n".join(
        body.format(scope=scope, e=e, t=t)
        for scope, e, t in (("week", "e_week", "t_week"), ("all", "e", "transfers"))
    ))


ORACLE["volume_totals"] = both(f"""
    SELECT '{{scope}}' AS scope, {money(SUM_ETH)} AS volume_eth, {money(SUM_USD)} AS volume_usd,
           count(DISTINCT contract_address) AS collections FROM {{e}}""")
ORACLE["contributors"] = both("""
    SELECT '{scope}' AS scope, count(DISTINCT contract_address) AS collections,
           count(DISTINCT (contract_address, token_id)) AS tokens FROM {e}""")
ORACLE["transfer_totals"] = both(
    "SELECT '{scope}' AS scope, count(*) AS transfers FROM {t}")
ORACLE["trade_totals"] = both("SELECT '{scope}' AS scope, count(*) AS trades FROM {e}")
ORACLE["market_mean"] = both(f"""
    SELECT '{{scope}}' AS scope, {AVG_ETH} AS price_mean, {money(SUM_ETH)} AS price_sum
    FROM {{e}}""")

_NEW = """
    SELECT contract_address FROM e_week
    EXCEPT
    SELECT e.contract_address FROM e, w WHERE e.block_number < w.lo"""
ORACLE["new_collections"] = sql(f"""
    SELECT contract_address, contract_name FROM contracts WHERE contract_address IN ({_NEW})""")
ORACLE["new_collections_by_sets"] = sql(_NEW)
ORACLE["new_mints"] = sql("""
    SELECT contract_address, contract_name FROM contracts, w WHERE init_block >= w.lo""")
ORACLE["new_mints_bounded"] = sql("""
    SELECT contract_address, contract_name FROM contracts, w
    WHERE init_block BETWEEN w.lo AND w.hi""")

HOLDERS = """holders AS (
  SELECT contract_address, token_id, to_address, from_address FROM (
    SELECT *, row_number() OVER (PARTITION BY contract_address, token_id
      ORDER BY block_number DESC, to_address DESC, from_address DESC) AS n
    FROM transfers) WHERE n = 1)"""
def active_sql(cutoff: str) -> str:
    return f"""cutoff AS (
  SELECT max(block_number) AS block FROM blocks WHERE date <= DATE '{cutoff}'),
last_sales AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY contract_address, token_id
      ORDER BY block_number DESC, seller DESC, buyer DESC) AS n
    FROM e) WHERE n = 1),
active AS (
  SELECT seller AS trader FROM last_sales, cutoff WHERE block_number > cutoff.block
  UNION
  SELECT buyer FROM last_sales, cutoff WHERE block_number > cutoff.block)"""


# The window's start, and a day so late that most holders have not traded since.
ACTIVE = active_sql("1995-03-06")
LATE = active_sql(LATE_CUTOFF)

ORACLE["holders"] = sql("SELECT * FROM holders", HOLDERS)
ORACLE["holder_summary"] = sql("""
    SELECT count(DISTINCT to_address) AS holders, count(*) AS tokens,
           count(*)::DOUBLE / count(DISTINCT to_address) AS average_holding FROM holders""", HOLDERS)
ORACLE["distinct_holders"] = sql(
    "SELECT count(*) AS holders FROM (SELECT DISTINCT to_address FROM holders)", HOLDERS)
ORACLE["active_traders"] = sql("SELECT trader FROM active", LATE)
ORACLE["active_holding"] = sql("""
    SELECT n AS active_traders, held AS held_tokens, held::DOUBLE / n AS average_holding
    FROM (SELECT (SELECT count(*) FROM active) AS n,
                 (SELECT count(*) FROM holders WHERE to_address IN (SELECT trader FROM active))
                   AS held)""", HOLDERS, LATE)
ORACLE["active_held_tokens"] = sql("""
    SELECT * FROM holders WHERE to_address IN (SELECT trader FROM active)""", HOLDERS, LATE)
ORACLE["idle_held_tokens"] = sql("""
    SELECT * FROM holders h WHERE NOT EXISTS (
      SELECT 1 FROM active a WHERE a.trader = h.to_address)""", HOLDERS, LATE)

ORACLE["summary_lines"] = sql(
    "\nUNION ALL\n".join(f"""
        SELECT printf('{scope}: traded %.2f ETH / %.2f USD in %d collections',
                 coalesce({money(SUM_ETH)}, 0), coalesce({money(SUM_USD)}, 0),
                 count(DISTINCT contract_address)) AS line FROM {e}
        UNION ALL
        SELECT printf('{scope}: %d transfers', count(*)) FROM {t}
        UNION ALL
        SELECT printf('{scope}: %d tokens traded', count(DISTINCT (contract_address, token_id)))
        FROM {e}
        UNION ALL
        SELECT printf('{scope}: %d trades', count(*)) FROM {e}
        UNION ALL
        SELECT printf('{scope}: mean price %.4f ETH, %.2f ETH in total',
                 coalesce({AVG_ETH}, 0), coalesce({money(SUM_ETH)}, 0)) FROM {e}"""
        for scope, e, t in (("week", "e_week", "t_week"), ("all", "e", "transfers")))
    + f"""
    UNION ALL
    SELECT printf('all: market cap %.2f ETH / %.2f USD', market_cap_eth, market_cap_usd)
    FROM ({_CAP})
    UNION ALL
    SELECT printf('week: %d new collections', count(*)) FROM ({_NEW})
    UNION ALL
    SELECT printf('week: %d collections minted', count(*)) FROM contracts, w
    WHERE init_block >= w.lo
    UNION ALL
    SELECT printf('all: %d holders with %.2f tokens each', count(DISTINCT to_address),
             count(*)::DOUBLE / count(DISTINCT to_address)) FROM holders
    UNION ALL
    SELECT printf('all: %d active traders', count(*)) FROM active""",
    _PRICES, """weights AS (
    SELECT contract_address, count(*) AS n FROM transfers GROUP BY contract_address)""",
    HOLDERS, ACTIVE)

ORACLE["latest_blocks_inner"] = sql("""
    SELECT b.block_number, CAST(b.date AS VARCHAR) AS date, b.timestamp_of_block
    FROM blocks b JOIN trades t ON b.block_number = t.block_number
    ORDER BY b.date DESC NULLS FIRST, b.block_number DESC LIMIT 500""")
ORACLE["latest_trades_right"] = sql("""
    SELECT t.* FROM blocks_orders b RIGHT JOIN trades t ON b.block_number = t.block_number
    ORDER BY b.date DESC NULLS FIRST, t.block_number DESC NULLS FIRST, t.transaction_hash,
      t.contract_address, t.token_id, t.seller, t.currency_address, t.price_value, t.buyer,
      t.market
    LIMIT 500""")
ORACLE["page_at_offset"] = sql("""
    SELECT transaction_hash, block_number, contract_address, token_id, seller, currency_address,
           price_value
    FROM trades WHERE currency_address IN ('A', 'N')
    ORDER BY block_number, contract_address, token_id, price_value, transaction_hash,
      currency_address, seller
    LIMIT 1000 OFFSET 2000""")
ORACLE["chunked_enrich"] = sql("""
    SELECT transaction_hash, block_number, contract_address, token_id, seller, currency_address,
           price_value, CAST(date AS VARCHAR) AS date, eth_usd_rate, price_usd,
           CAST(block_number >= 9496 AS INT) + CAST(block_number >= 9862 AS INT)
           + CAST(block_number >= 10227 AS INT) + CAST(block_number >= 10592 AS INT)
           + CAST(block_number >= 10957 AS INT) + CAST(block_number >= 11323 AS INT) AS page
    FROM priced""")
ORACLE["stream_enrich"] = sql("""
    SELECT currency_address, contract_address, price_value, block_number,
           CAST(date AS VARCHAR) AS date, eth_usd_rate, price_usd FROM priced""")

ORACLE["balanced_enrich"] = sql("""
    SELECT transaction_hash, block_number, contract_address, token_id, seller, currency_address, price_value,
           CAST(date AS VARCHAR) AS date, eth_usd_rate, price_usd FROM priced""")

ORACLE["stream_repriced"] = ORACLE["stream_enrich"]

ORACLE["stream_waiting"] = sql("""
    SELECT currency_address, contract_address, price_value, block_number FROM trades t
    WHERE currency_address IN ('A', 'N') AND NOT EXISTS (
      SELECT 1 FROM blocks JOIN rates USING (date) WHERE blocks.block_number = t.block_number)""")

# Minutes as blocks: those of some users' events only, every third one twice; two rates on
# every third day.
_MINUTE = "CAST(floor(epoch(ts) / 60) AS BIGINT)"
_MINUTES = f"""WITH seen AS (
      SELECT DISTINCT {_MINUTE} AS block_number, CAST(ts AS DATE) AS date FROM events WHERE user_id % 7 <> 0),
    blocks AS (SELECT * FROM seen UNION ALL SELECT * FROM seen WHERE block_number % 3 = 0),
    days AS (SELECT DISTINCT CAST(ts AS DATE) AS date, {DAY.format('ts')} AS day FROM events),
    rates AS (SELECT date, CAST(1000 + day % 997 AS DOUBLE) AS eth_usd_rate FROM days WHERE day % 10 <> 0
      UNION ALL SELECT date, 1.5 AS eth_usd_rate FROM days WHERE day % 3 = 0),
    calendar AS (SELECT * FROM blocks JOIN rates USING (date)),
    trades AS (SELECT event_id, {_MINUTE} AS block_number, value AS price_value FROM events)"""
ORACLE["minute_prices"] = f"""{_MINUTES}
    SELECT event_id, block_number, price_value, CAST(date AS VARCHAR) AS date,
           CAST(eth_usd_rate AS DOUBLE) AS eth_usd_rate, price_value * eth_usd_rate AS price_usd
    FROM trades JOIN calendar USING (block_number)"""
ORACLE["unpriced_minutes"] = f"""{_MINUTES}
    SELECT * FROM trades WHERE block_number NOT IN (SELECT block_number FROM calendar)"""

ORACLE["table_row_counts"] = sql("\nUNION ALL\n".join(
    f"SELECT '{name}' AS table_name, count(*) AS rows FROM {name}"
    for name in ("contracts", "blocks", "rates", "trades", "transfers")))
for _name in ("file_rows", "table_stat_rows"):
    ORACLE[_name] = "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, count(*) AS rows FROM {name}" for name in ("lineitem", "orders", "part"))
ORACLE["table_pages"] = "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS table_name, count(*) AS rows, CAST(1388 AS BIGINT) AS rows_per_page,
        CAST(ceil(count(*) / 1388.0) AS BIGINT) AS pages FROM {name}"""
    for name in ("lineitem", "orders", "part"))
ORACLE["where_in_currency"] = """
    SELECT l_orderkey, l_partkey, l_extendedprice, l_returnflag FROM lineitem
    WHERE l_returnflag = 'A' OR l_returnflag = 'N'"""
ORACLE["block_range_filter"] = sql("""
    SELECT transaction_hash, block_number, contract_address, token_id, seller, currency_address,
           price_value
    FROM trades WHERE block_number >= 9500 AND block_number <= 9800 AND price_value > 50000""")
ORACLE["dated_rates"] = sql("""
    SELECT b.block_number, b.timestamp_of_block, CAST(b.date AS VARCHAR) AS date,
           CAST(r.date AS VARCHAR) AS date_of_rate, r.eth_usd_rate
    FROM blocks b JOIN rates r ON b.date = r.date""")
ORACLE["trades_and_orders"] = f"""
    SELECT l_orderkey AS id, {DAY.format('l_shipdate')} AS block_number,
           {DAY.format('o_orderdate')} AS block_number_right
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
ORACLE["trades_without_block"] = sql("""
    SELECT t.block_number, CAST(b.date AS VARCHAR) AS date, t.trades
    FROM blocks_orders b RIGHT JOIN
      (SELECT block_number, count(*) AS trades FROM trades GROUP BY block_number) t
      ON b.block_number = t.block_number""")

# The parts of page addresses and turns that ``checks.queries`` validates.
_PAGES = """WITH parts AS (SELECT page_id, regexp_replace(url, '^https://', '') AS url,
    nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS parameters,
    regexp_extract(url, '/([^/]*)$', 1) AS number FROM pages)"""
_URL = f"regexp_matches(url, '{URL_PATTERN}')"
_NOT_URL = f"(url IS NOT NULL AND NOT {_URL})"
_NOT_NUMBER = "(number IS NOT NULL AND TRY_CAST(number AS BIGINT) IS NULL)"
ORACLE["validate_pages"] = f"""
    {_PAGES}, n AS (SELECT count(*) AS checked,
        count(*) FILTER (WHERE {_NOT_URL}) AS a,
        count(*) FILTER (WHERE parameters IS NULL) AS b,
        count(*) FILTER (WHERE {_NOT_NUMBER}) AS c FROM parts)
    SELECT checked, 'url_url' AS rule, a AS violations FROM n
    UNION ALL SELECT checked, 'parameters_required', b FROM n
    UNION ALL SELECT checked, 'number_integer', c FROM n"""
ORACLE["valid_pages"] = f"""
    {_PAGES} SELECT page_id, url FROM parts
    WHERE NOT {_NOT_URL} AND NOT {_NOT_NUMBER}"""
_TURNS = """WITH parts AS (SELECT conv_id, turn, role,
    nullif(regexp_extract(text, '\n([^\n]*)', 1), '') AS second_line FROM conversations)"""
_NOT_ROLE = "(role IS NULL OR role NOT IN ('user', 'assistant'))"
ORACLE["validate_conversations"] = f"""
    {_TURNS}, n AS (SELECT count(*) AS checked,
        count(*) FILTER (WHERE second_line IS NULL) AS a,
        count(*) FILTER (WHERE {_NOT_ROLE}) AS b FROM parts)
    SELECT checked, 'second_line_required' AS rule, a AS violations FROM n
    UNION ALL SELECT checked, 'role_choice', b FROM n"""
ORACLE["invalid_turns"] = f"""
    {_TURNS} SELECT * FROM (
      SELECT conv_id, turn, role, concat_ws(',',
        CASE WHEN second_line IS NULL THEN 'second_line_required' END,
        CASE WHEN {_NOT_ROLE} THEN 'role_choice' END) AS violations
      FROM parts)
    WHERE violations <> ''"""

ORACLE["scalar_dates"] = """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS day,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS second,
           strftime(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000),
             '%Y-%m-%d %H:%M:%S') AS from_epoch,
           strftime(CAST(ts AS DATE) - 7, '%Y-%m-%d') AS week_before,
           strftime(CAST(ts AS DATE) + 6, '%Y-%m-%d') AS week_end,
           date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days_in
    FROM events"""
ORACLE["scalar_text"] = r"""
    SELECT event_id, CAST(regexp_extract(props, '\d+') AS BIGINT) AS first_number,
           'event ' || event_id || ': ' || event_type || ' by user ' || user_id AS line
    FROM events"""
ORACLE["scalar_numbers"] = """
    SELECT event_id, event_id + user_id AS added, value * value AS multiplied,
           CAST(event_id AS DOUBLE) / NULLIF(user_id % 3, 0) AS divided,
           event_id // NULLIF(user_id % 7, 0) AS floor_divided,
           event_id % NULLIF(user_id % 7, 0) AS remainder,
           CAST(ceil(event_id / NULLIF(user_id % 7, 0)) AS BIGINT) AS pages,
           CAST(CAST(CAST(value AS DECIMAL(38,4)) AS DECIMAL(38,1)) AS DOUBLE) AS rounded,
           event_id >= user_id AS not_less, event_id < 5000 AND user_id > 10 AS both
    FROM events"""


# -- the weekly report: every figure above in one long table --------------------------------

_KEYS = {"c": "contract_address", "ct": "contract_address, token_id", "m": "market"}


def _board(
    scope: str, metric: str, cte: str, value: str, rank_by: str, keys: str, limit: str = "rank <= 10"
) -> str:
    contract = "CAST(contract_address AS VARCHAR)" if keys != "m" else "CAST(NULL AS VARCHAR)"
    token = "CAST(token_id AS VARCHAR)" if keys == "ct" else "CAST(NULL AS VARCHAR)"
    label = "market" if keys == "m" else "contract_name"
    return f"""SELECT '{scope}' AS scope, '{metric}' AS metric, rank, {contract} AS contract_address,
        {token} AS token_id, {label} AS label, CAST({value} AS DOUBLE) AS value
      FROM (SELECT *, row_number() OVER (ORDER BY {rank_by} DESC NULLS FIRST, {_KEYS[keys]}) AS rank
            FROM {cte}) WHERE {limit}"""


def _figure(scope: str, metric: str, value: str, source: str) -> str:
    null = "CAST(NULL AS VARCHAR)"
    return f"""SELECT '{scope}', '{metric}', CAST(NULL AS BIGINT), {null}, {null}, {null},
        CAST({value} AS DOUBLE) FROM {source}"""


def _weekly_report() -> str:
    ctes, parts = [HOLDERS, ACTIVE, _PRICES], []
    ctes.append("""weights AS (SELECT contract_address, count(*) AS n,
        count(DISTINCT token_id) AS tokens FROM transfers GROUP BY contract_address)""")
    for scope, e, t in (("week", "e_week", "t_week"), ("all", "e", "transfers")):
        for cte, keys in ((f"c_{scope}", "contract_address, contract_name"),
                          (f"ct_{scope}", "contract_address, token_id, contract_name"),
                          (f"m_{scope}", "market")):
            ctes.append(f"""{cte} AS (SELECT {keys}, count(*) AS n, {money(SUM_USD, 4)} AS usd4,
                {money(SUM_USD)} AS usd, {AVG_ETH} AS mean, max(price_value) AS top,
                min(price_value) AS low FROM {e} GROUP BY {keys})""")
        parts.append(_board(scope, "collection_volume_usd", f"c_{scope}", "usd4", "usd4", "c"))
        parts.append(_board(scope, "market_volume_usd", f"m_{scope}", "usd", "usd", "m", "true"))
        parts.append(_board(scope, "collection_trades", f"c_{scope}", "n", "n", "c"))
        parts.append(_board(scope, "token_trades", f"ct_{scope}", "n", "n", "ct"))
        for level, keys in (("collection", "c"), ("token", "ct")):
            for stat, column in (("avg", "mean"), ("max", "top"), ("min", "low")):
                parts.append(_board(
                    scope, f"{level}_price_{stat}", f"{keys}_{scope}", column, "mean", keys))
        parts.append(f"""SELECT scope, extreme, CAST(NULL AS BIGINT),
            CAST(contract_address AS VARCHAR), CAST(token_id AS VARCHAR), contract_name, price
            FROM ({_extremes(scope, e)})""")
        parts += [
            _figure(scope, "volume_eth", money(SUM_ETH), e),
            _figure(scope, "volume_usd", money(SUM_USD), e),
            _figure(scope, "collections", "count(DISTINCT contract_address)", e),
            _figure(scope, "tokens", "count(DISTINCT (contract_address, token_id))", e),
            _figure(scope, "transfers", "count(*)", t),
            _figure(scope, "trades", "count(*)", e),
            _figure(scope, "price_mean", AVG_ETH, e),
        ]
    for name, weight in (("market_cap", "n"), ("market_cap_tokens", "tokens")):
        for unit in ("eth", "usd"):
            parts.append(_figure(
                "all", f"{name}_{unit}",
                money(f"sum(CAST({weight} * {unit}_avg AS DECIMAL(38,8)))"),
                "weights JOIN prices USING (contract_address)"))
    malformed = "trades WHERE currency_address IN ('A', 'N') AND NOT abs(price_value) <= 1e12"
    parts += [
        _figure("all", "malformed_trades", "count(*)", malformed),
        _figure("week", "new_collections", "count(*)", f"({_NEW})"),
        _figure("week", "new_mints", "count(*)", "contracts, w WHERE init_block >= w.lo"),
        _figure("week", "new_mints_bounded", "count(*)",
                "contracts, w WHERE init_block BETWEEN w.lo AND w.hi"),
        _figure("all", "holders", "count(DISTINCT to_address)", "holders"),
        _figure("all", "held_tokens", "count(*)", "holders"),
        _figure("all", "average_holding", "count(*)::DOUBLE / count(DISTINCT to_address)", "holders"),
        _figure("all", "active_traders", "count(*)", "active"),
        _figure("all", "active_held_tokens", "count(*)",
                "holders WHERE to_address IN (SELECT trader FROM active)"),
        _figure("all", "active_average_holding",
                "count(*)::DOUBLE / (SELECT count(*) FROM active)",
                "holders WHERE to_address IN (SELECT trader FROM active)"),
    ]
    return sql("\nUNION ALL\n".join(parts), *ctes)


ORACLE["weekly_report"] = _weekly_report()

# The same figures, whatever the rollups they come from.
for _name in ("volume_collections_week", "volume_collections_all", "price_stats_tokens_all", "price_extremes",
              "volume_totals", "contributors", "new_collections", "market_cap", "transfer_totals",
              "holder_summary", "weekly_report"):
    ORACLE[f"rolled_{_name}"] = ORACLE[_name]
ORACLE["arrived_holders"] = ORACLE["holders"]
for _name in ("price_stats_tokens_all", "volume_collections_week", "contributors"):
    ORACLE[f"clustered_{_name}"] = ORACLE[_name]

# Traders are sellers and buyers; the week before ends where the window begins.
ORACLE["bitmap_contributors"] = ORACLE["contributors"]
_PARTIES = "SELECT seller AS trader, block_number FROM e UNION ALL SELECT buyer, block_number FROM e"
ORACLE["bitmap_traders"] = sql("""
    SELECT 'week' AS scope, count(DISTINCT trader) AS traders FROM p, w WHERE block_number BETWEEN lo AND hi
    UNION ALL SELECT 'all', count(DISTINCT trader) FROM p""", f"p AS ({_PARTIES})")


def _returning() -> str:
    kinds = {"collections": ("e", "contract_address"), "tokens": ("e", "contract_address || '/' || token_id"),
             "traders": ("p", "trader")}
    ctes = [f"p AS ({_PARTIES})", """
b AS (SELECT min(block_number) AS blo, max(block_number) AS bhi FROM blocks
      WHERE date BETWEEN DATE '1995-02-27' AND DATE '1995-03-05')"""]
    for kind, (source, key) in kinds.items():
        ctes.append(f"""
{kind}_seen AS (
  SELECT {key} AS k, bool_or(block_number BETWEEN lo AND hi) AS a, bool_or(block_number BETWEEN blo AND bhi) AS b
  FROM {source}, w, b GROUP BY 1)""")
    tests = {"week": "a", "before": "b", "any": "a OR b", "both": "a AND b"}
    return sql(" UNION ALL ".join(
        f"SELECT '{scope}' AS scope, " + ", ".join(
            f"(SELECT count(*) FROM {kind}_seen WHERE {test}) AS {kind}" for kind in kinds)
        for scope, test in tests.items()), *ctes)


ORACLE["bitmap_returning"] = _returning()
