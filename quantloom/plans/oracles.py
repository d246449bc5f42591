"""The same queries as ANSI SQL, written independently of the Spark plans."""

from __future__ import annotations

BASE = """
today AS (SELECT max(CAST(l_shipdate AS DATE)) AS d, CAST(year(max(l_shipdate)) AS INTEGER) AS y FROM lineitem),
listing AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS ticker, s_name AS name,
         CAST(s_nationkey AS BIGINT) * 1000000 AS shares
  FROM supplier),
tradable AS (SELECT * FROM listing WHERE NOT regexp_matches(name, '07$|13$') AND shares > 0),
code_map AS (
  SELECT lpad(CAST(s_suppkey + 100000 AS VARCHAR), 12, '0') AS corp_code,
         lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS ticker
  FROM supplier WHERE s_suppkey % 10 <> 9),
bars AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS ticker, CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE)
           / CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) AS close,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
  FROM lineitem GROUP BY 1, 2),
yearly AS (
  SELECT l_suppkey AS k, CAST(year(l_shipdate) AS INTEGER) AS y,
         sum(CASE WHEN l_returnflag = 'R' THEN -2 ELSE 1 END * CAST(round(l_extendedprice * 100) AS BIGINT)) AS signed,
         any_value(s_acctbal) AS acctbal
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
statement_items AS (
  SELECT k, y, 'net_income' AS account,
         CASE WHEN k % 23 = 1 THEN '-'
              ELSE CAST(CAST(round(CAST(signed AS DOUBLE) / CAST(100000 AS DOUBLE)) AS BIGINT) AS VARCHAR) || ',000'
         END AS amount_raw
  FROM yearly WHERE (k + y) % 7 <> 0
  UNION ALL
  SELECT k, y, 'total_equity', CAST(CAST(floor(acctbal) AS BIGINT) AS VARCHAR) || ',000'
  FROM yearly WHERE (k + y) % 7 <> 0
  UNION ALL
  SELECT k, y, 'total_equity', CAST(CAST(floor(acctbal) AS BIGINT) + 500 AS VARCHAR) || ',000'
  FROM yearly WHERE (k + y) % 7 <> 0 AND k % 5 = 0
  UNION ALL
  SELECT k, y, 'revenue', '1,000' FROM yearly),
statements AS (
  SELECT lpad(CAST(k AS VARCHAR), 10, '0') AS ticker, y AS "year", account, amount_raw FROM statement_items),
amounts AS (SELECT *, TRY_CAST(replace(amount_raw, ',', '') AS DOUBLE) AS amount FROM statements),
pivoted AS (
  SELECT ticker, "year",
         avg(CASE WHEN account = 'net_income' THEN amount END) AS net_income,
         avg(CASE WHEN account = 'total_equity' THEN amount END) AS total_equity
  FROM amounts WHERE account IN ('net_income', 'total_equity') GROUP BY 1, 2
  HAVING count(amount) > 0),
headlines AS (
  SELECT lpad(CAST(doc_id % (SELECT count(*) FROM supplier) AS VARCHAR), 10, '0') AS ticker,
         doc_id AS seq, doc_id % 11 AS age_days, text AS title,
         CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label,
         CAST(0.5 AS DOUBLE) + (doc_id % 50) / CAST(100 AS DOUBLE) AS score
  FROM documents LEFT JOIN labels USING (doc_id)),
latest_news AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY age_days, seq) AS rn
    FROM headlines WHERE age_days <= 3)
  WHERE rn <= 5),
serve_bars AS (SELECT bars.* FROM bars, today WHERE date BETWEEN d - 400 AND d),
train_bars AS (SELECT bars.* FROM bars, today WHERE date BETWEEN d - 1095 AND d),
serve_features AS (
  SELECT *, close / nullif(lag(close, 20) OVER s, 0) - 1 AS ret_20,
         close / nullif(lag(close, 60) OVER s, 0) - 1 AS ret_60,
         CASE WHEN count(close) OVER m = 20 THEN stddev_samp(close) OVER m / nullif(avg(close) OVER m, 0) END AS vol_20,
         count(*) OVER (PARTITION BY ticker) AS n,
         row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back
  FROM serve_bars
  WINDOW s AS (PARTITION BY ticker ORDER BY date),
         m AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
valued AS (
  SELECT ticker, name, date, close AS last_close, close * shares / CAST(100000000 AS DOUBLE) AS market_cap_eok,
         ret_20, ret_60, vol_20,
         CASE WHEN net_income > 0 THEN close * shares / net_income END AS per,
         CASE WHEN total_equity > 0 THEN close * shares / total_equity END AS pbr,
         CASE WHEN total_equity > 0 THEN net_income / total_equity END AS roe
  FROM serve_features
  JOIN tradable USING (ticker)
  JOIN code_map USING (ticker)
  JOIN (SELECT ticker, net_income, total_equity FROM pivoted, today WHERE "year" = y - 1) USING (ticker)
  WHERE back = 1 AND n >= 61),
imputed AS (
  SELECT ticker, name, date, last_close, market_cap_eok,
         coalesce(ret_20, (SELECT median(ret_20) FROM valued), 0) AS ret_20,
         coalesce(ret_60, (SELECT median(ret_60) FROM valued), 0) AS ret_60,
         coalesce(vol_20, (SELECT median(vol_20) FROM valued), 0) AS vol_20,
         coalesce(per, (SELECT median(per) FROM valued), 0) AS per,
         coalesce(pbr, (SELECT median(pbr) FROM valued), 0) AS pbr,
         coalesce(roe, (SELECT median(roe) FROM valued), 0) AS roe
  FROM valued),
filled_bars AS (
  SELECT t.ticker, t.date, t.close, t.volume,
         coalesce(last_value(net_income IGNORE NULLS) OVER b, first_value(net_income IGNORE NULLS) OVER a) AS net_income,
         coalesce(last_value(total_equity IGNORE NULLS) OVER b, first_value(total_equity IGNORE NULLS) OVER a) AS total_equity
  FROM train_bars t
  LEFT JOIN (SELECT pivoted.* FROM pivoted, today WHERE "year" BETWEEN y - 4 AND y - 1) p
    ON p.ticker = t.ticker AND p."year" = year(t.date)
  WINDOW b AS (PARTITION BY t.ticker ORDER BY t.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY t.ticker ORDER BY t.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
complete_bars AS (SELECT * FROM filled_bars WHERE net_income IS NOT NULL AND total_equity IS NOT NULL),
history_bars AS (
  SELECT * FROM (
    SELECT c.*, shares, count(*) OVER (PARTITION BY c.ticker) AS n,
           row_number() OVER (PARTITION BY c.ticker ORDER BY c.date) - 1 AS i
    FROM complete_bars c JOIN tradable USING (ticker) JOIN code_map USING (ticker))
  WHERE n >= 120),
"""


def indicators(source: str) -> str:
    """Step-by-step recursion of the indicators over `source` (ticker, i, close)."""
    return f"""
moves AS (
  SELECT ticker, i, close, close - lag(close) OVER (PARTITION BY ticker ORDER BY i) AS move FROM {source}),
steps AS (
  SELECT ticker, i, CAST(0 AS DOUBLE) AS gains, CAST(0 AS DOUBLE) AS losses, close AS fast, close AS slow,
         CAST(0 AS DOUBLE) AS signal, CAST(NULL AS DOUBLE) AS macd
  FROM moves WHERE i = 0
  UNION ALL
  SELECT ticker, i, gains, losses, fast, slow,
         CASE WHEN i < 25 THEN 0 WHEN i < 33 THEN signal + fast - slow WHEN i = 33 THEN (signal + fast - slow) / 9
              ELSE signal + (fast - slow - signal) / 5 END,
         CASE WHEN i >= 25 THEN fast - slow END
  FROM (
    SELECT m.ticker, m.i, s.signal,
           s.gains * 13 / 14 + greatest(m.move, 0) AS gains, s.losses * 13 / 14 + greatest(-m.move, 0) AS losses,
           CASE WHEN m.i < 11 THEN s.fast + m.close WHEN m.i = 11 THEN (s.fast + m.close) / 12
                ELSE s.fast + (m.close - s.fast) * 2 / 13 END AS fast,
           CASE WHEN m.i < 25 THEN s.slow + m.close WHEN m.i = 25 THEN (s.slow + m.close) / 26
                ELSE s.slow + (m.close - s.slow) * 2 / 27 END AS slow
    FROM steps s JOIN moves m ON m.ticker = s.ticker AND m.i = s.i + 1)),
indicators AS (
  SELECT ticker, i,
         CASE WHEN i >= 14 THEN 100 * gains / nullif(gains + losses, 0) END AS rsi_14,
         macd, CASE WHEN i >= 33 THEN signal END AS macd_signal, CASE WHEN i >= 33 THEN macd - signal END AS macd_hist
  FROM steps),
"""


NUMBERED = """
numbered AS (
  SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM bars),
"""

HISTORY = (
    indicators("history_bars")
    + """
history AS (
  SELECT h.ticker, h.date, close * shares AS market_cap,
         close * shares / nullif(net_income, 0) AS per, close * shares / nullif(total_equity, 0) AS pbr,
         net_income / nullif(total_equity, 0) AS roe,
         close / nullif(lag(close, 20) OVER s, 0) - 1 AS ret_20,
         close / nullif(lag(close, 60) OVER s, 0) - 1 AS ret_60,
         CASE WHEN count(close) OVER m = 20 THEN stddev_samp(close) OVER m / nullif(avg(close) OVER m, 0) END AS vol_20,
         rsi_14, macd, macd_hist, macd_signal,
         CAST(coalesce(lead(close, 20) OVER s / nullif(close, 0) > CAST(1.05 AS DOUBLE), false) AS INTEGER) AS target
  FROM history_bars h JOIN indicators j ON j.ticker = h.ticker AND j.i = h.i
  WINDOW s AS (PARTITION BY h.ticker ORDER BY h.date),
         m AS (PARTITION BY h.ticker ORDER BY h.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
rows_ AS (
  SELECT * FROM history
  WHERE ret_20 IS NOT NULL AND ret_60 IS NOT NULL AND vol_20 IS NOT NULL AND per IS NOT NULL AND pbr IS NOT NULL
    AND roe IS NOT NULL AND rsi_14 IS NOT NULL AND macd IS NOT NULL AND macd_hist IS NOT NULL
    AND macd_signal IS NOT NULL),
ruled AS (
  SELECT target, CAST(round(ret_20, 6) > 0 AS INTEGER) AS prediction, round(ret_20, 6) AS score FROM rows_),
"""
)

MEASURES = ["ret_20", "ret_60", "vol_20", "per", "pbr", "roe", "rsi_14", "macd", "macd_hist", "macd_signal"]


def scores(source: str) -> str:
    """Unrounded and rounded factor scores of `source`; missing measures rank after all others."""

    def last(column: str) -> str:
        return f"rank() OVER (ORDER BY {column} ASC NULLS LAST)"

    def two(column: str) -> str:
        return f"round_even({column} * 100, 0) / 100 AS {column}"

    return f"""
ranks AS (
  SELECT *, rank() OVER (ORDER BY CASE WHEN per > 0 THEN 1 / per ELSE CAST('-inf' AS DOUBLE) END)
            + rank() OVER (ORDER BY CASE WHEN pbr > 0 THEN 1 / pbr ELSE CAST('-inf' AS DOUBLE) END) AS value_sum,
         {last("ret_20")} + {last("ret_60")} AS momentum_sum,
         {last("roe")} AS quality_rank, {last("vol_20")} AS volatility_rank,
         CAST(count(*) OVER () AS DOUBLE) AS n
  FROM {source}),
raw_scores AS (
  SELECT ticker, name, last_close, market_cap_eok, ret_20,
         rank() OVER (ORDER BY value_sum) / n * 100 AS value_score, quality_rank / n * 100 AS quality_score,
         rank() OVER (ORDER BY momentum_sum) / n * 100 AS momentum_score, CAST(0 AS DOUBLE) AS supply_score,
         volatility_rank / n * 100 AS volatility_score
  FROM ranks),
scored AS (
  SELECT ticker, name, last_close, market_cap_eok, ret_20, {two("value_score")}, {two("quality_score")},
         {two("momentum_score")}, supply_score, {two("volatility_score")}
  FROM raw_scores),
blended AS (
  SELECT *, CASE WHEN ret_20 > 0 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS rule,
         round(value_score * 0.2 + quality_score * 0.2 + momentum_score * 0.3 + volatility_score * 0.1, 9) AS blend
  FROM scored),
"""


def ranking(blend: str) -> str:
    return f"""
scaled AS (
  SELECT *, CASE WHEN max({blend}) OVER () > min({blend}) OVER ()
                 THEN 100 * ({blend} - min({blend}) OVER ()) / (max({blend}) OVER () - min({blend}) OVER ())
                 ELSE 50 END AS full_score
  FROM blended),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY full_score DESC, ticker) AS final_rank,
         round_even(full_score * 100, 0) / 100 AS final_score
  FROM scaled),
"""


SAMPLES = """
scaled_bars AS (
  SELECT ticker, date, CASE WHEN max(close) OVER t = min(close) OVER t THEN 0
                            ELSE (close - min(close) OVER t) / (max(close) OVER t - min(close) OVER t) END AS scaled
  FROM bars WINDOW t AS (PARTITION BY ticker)),
samples AS (
  SELECT * FROM (
    SELECT ticker, date, scaled, count(*) OVER f AS length, first_value(scaled) OVER f AS first_value,
           sum(scaled) OVER f AS total,
           lead(scaled, 20) OVER (PARTITION BY ticker ORDER BY date) AS later
    FROM scaled_bars
    WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
  WHERE length = 60 AND later IS NOT NULL),
"""


_TICKS = """
ticks AS (
  SELECT lpad(CAST(n_regionkey AS VARCHAR), 10, '0') AS ticker,
         epoch_us(CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)) + l_orderkey * 8 + l_linenumber AS moment,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) AS close
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
numbered_ticks AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY moment) - 1 AS i FROM ticks),
"""

_DOCUMENTS = """
landed AS (SELECT DISTINCT ticker, "year" FROM statements, today WHERE "year" BETWEEN y - 2 AND y - 1),
"""

_TIME_FOLDS = """
ended AS (
  SELECT ticker, date, coalesce(lead(date, 20) OVER (PARTITION BY ticker ORDER BY date), max(date) OVER (PARTITION BY ticker)) AS finish
  FROM train_bars),
days AS (SELECT date, count(*) AS n FROM ended GROUP BY date),
placed_days AS (SELECT date, sum(n) OVER (ORDER BY date) - n AS before, sum(n) OVER () AS total FROM days),
folded AS (
  SELECT ended.*, CAST(before >= total / 3.0 AS INTEGER) + CAST(before >= total * 2 / 3.0 AS INTEGER) AS own
  FROM ended JOIN placed_days USING (date)),
held AS (SELECT own AS fold, date, max(finish) + 10 AS upto FROM folded GROUP BY own, date),
parted AS (
  SELECT f.fold, r.ticker, r.date,
         CASE WHEN own = f.fold THEN 'test'
              WHEN EXISTS (SELECT 1 FROM held h WHERE h.fold = f.fold AND r.date <= h.upto AND h.date <= r.finish) THEN 'purged'
              ELSE 'train' END AS part
  FROM folded r, (SELECT DISTINCT fold FROM held) f),
"""

_WORD_MODEL = """
spoken AS (SELECT seq, unnest(regexp_extract_all(lower(title), '[a-zà-ÿ]+')) AS w FROM headlines),
counted_words AS (SELECT seq, substr(md5(w), 1, 4) AS bucket, count(*) AS n FROM spoken GROUP BY ALL),
told AS (SELECT seq, label, substr(md5(CAST(seq AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3', '4') AS held FROM headlines WHERE seq IN (SELECT doc_id FROM labels)),
seen_words AS (SELECT label, bucket, sum(n) AS c FROM counted_words JOIN told USING (seq) WHERE NOT held GROUP BY ALL),
label_totals AS (
  SELECT label, ln(count(*) / CAST((SELECT count(*) FROM told WHERE NOT held) AS DOUBLE)) AS prior,
         ln(coalesce((SELECT sum(c) FROM seen_words s WHERE s.label = t.label), 0) + 65536) AS norm
  FROM told t WHERE NOT held GROUP BY label),
evidence AS (
  SELECT h.seq, l.label,
         prior + coalesce(sum(n * (coalesce(ln(c + 1), 0) - norm)), 0) AS score
  FROM headlines h CROSS JOIN label_totals l
  LEFT JOIN counted_words w ON w.seq = h.seq LEFT JOIN seen_words s ON s.label = l.label AND s.bucket = w.bucket
  GROUP BY h.seq, l.label, prior),
verdicts AS (
  SELECT seq, arg_min(label, place) AS label, max(score) FILTER (place = 1) - max(score) FILTER (place = 2) AS log_odds
  FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, label) AS place FROM evidence) GROUP BY seq),
"""


def _sql(body: str, *parts: str) -> str:
    return "WITH RECURSIVE " + (BASE + "".join(parts)).strip().rstrip(",") + "\n" + body.strip()


def _r(digits: int, *columns: str) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


_IMPUTED = scores("imputed")
_PLAIN = scores("valued")
_LAST_CLOSES = """
SELECT ticker, name, last_close * shares AS market_cap
FROM tradable JOIN (SELECT ticker, arg_max(close, date) AS last_close FROM bars GROUP BY ticker) USING (ticker)
ORDER BY last_close * shares DESC, ticker LIMIT 50
"""
_SCORES = "value_score, quality_score, momentum_score, supply_score, volatility_score"
_UP = "|".join(("gain", "growth", "profit", "record", "rise", "strong"))
_DOWN = "|".join(("decline", "default", "fall", "loss", "lawsuit", "weak"))

ORACLES = {
    "listing_scan": _sql("SELECT ticker, name, shares FROM listing"),
    "listing_filter": _sql("SELECT ticker, name, shares FROM tradable"),
    "bars_range": _sql("SELECT ticker, date, close, volume FROM serve_bars"),
    "as_of_date": _sql("SELECT d AS as_of FROM today"),
    "statements_scan": _sql(
        'SELECT ticker, "year", account, amount_raw FROM statements, today WHERE "year" = y - 1'
    ),
    "statements_by_year": _sql(
        'SELECT ticker, "year", account, amount_raw FROM statements, today WHERE "year" BETWEEN y - 4 AND y - 1'
    ),
    "statement_documents": _sql(
        "SELECT ticker, \"year\", account, amount_raw FROM statements WHERE ticker NOT LIKE '%7'"
    ),
    "code_map_scan": _sql("SELECT corp_code, ticker FROM code_map"),
    "code_map_build": _sql("SELECT corp_code, ticker FROM code_map"),
    "landed_statements": _sql(
        """SELECT ticker, "year", account, amount_raw, NULL AS reason, CAST(NULL AS BIGINT) AS documents
        FROM statements JOIN landed USING (ticker, "year") WHERE NOT regexp_matches(ticker, '[37]$')
        UNION ALL
        SELECT NULL, "year", NULL, NULL, CASE WHEN ticker LIKE '%3' THEN 'broken' ELSE 'status 013' END, count(*)
        FROM landed WHERE regexp_matches(ticker, '[37]$') GROUP BY "year", 5""",
        _DOCUMENTS,
    ),
    "code_map_round_trip": _sql(
        """SELECT CASE WHEN CAST(ticker AS BIGINT) % 3 = 0 THEN corp_code || ',A'
                       WHEN CAST(ticker AS BIGINT) % 5 = 0 THEN '"' || corp_code || '"' ELSE corp_code END AS corp_code, ticker
        FROM code_map"""
    ),
    "merged_providers": _sql(
        """, shipped AS (
          SELECT lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS ticker, CAST(l_shipdate AS DATE) AS date,
            CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE)
              / CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) AS close,
            CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
          FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)
        SELECT ticker, date, coalesce(a.close, b.close) AS close, coalesce(a.volume, b.volume) AS volume,
          CASE WHEN a.close IS NULL THEN 'all' ELSE 'shipped' END AS provider,
          CASE WHEN a.close IS NULL THEN 1 ELSE 2 END AS n_providers, CASE WHEN a.close IS NULL THEN 'shipped' ELSE '' END AS missing,
          coalesce(abs(a.close - b.close) > CAST(0.01 AS DOUBLE) * abs(a.close), false) AS conflict
        FROM bars b LEFT JOIN shipped a USING (ticker, date)"""
    ),
    "point_in_time": _sql(
        f""", published AS (
          SELECT p.*, make_date(CAST("year" + 1 AS INTEGER), 3, 1) + CAST(CAST(ticker AS BIGINT) % 90 AS INTEGER) AS published FROM pivoted p)
        SELECT b.ticker, b.date, {_r(3, "net_income", "total_equity")}
        FROM bars b ASOF LEFT JOIN published p ON b.ticker = p.ticker AND b.date >= p.published"""
    ),
    "tick_features": _sql(
        f"""SELECT t.ticker, moment,
          round(close / nullif(lag(close, 20) OVER s, 0) - 1, 4) + 0.0 AS ret_20, round(close / nullif(lag(close, 60) OVER s, 0) - 1, 4) + 0.0 AS ret_60,
          round(CASE WHEN count(close) OVER m = 20 THEN stddev_samp(close) OVER m / nullif(avg(close) OVER m, 0) END, 4) + 0.0 AS vol_20,
          {_r(4, "rsi_14")}, {_r(3, "macd", "macd_hist", "macd_signal")},
          CAST(coalesce(lead(close, 20) OVER s / nullif(close, 0) > CAST(1.05 AS DOUBLE), false) AS INTEGER) AS target
        FROM numbered_ticks t JOIN indicators j ON j.ticker = t.ticker AND j.i = t.i
        WINDOW s AS (PARTITION BY t.ticker ORDER BY moment),
               m AS (PARTITION BY t.ticker ORDER BY moment ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
        _TICKS,
        indicators("numbered_ticks"),
    ),
    "purged_folds": _sql(
        'SELECT fold, part, count(*) AS rows, min(date) AS "first", max(date) AS "last" FROM parted GROUP BY fold, part', _TIME_FOLDS
    ),
    "headline_bayes": _sql("SELECT seq, label, round(log_odds, 4) + 0.0 AS log_odds FROM verdicts", _WORD_MODEL),
    "headline_accuracy": _sql(
        """SELECT t.label, count(*) AS rows, count(*) FILTER (t.label = v.label) AS "right"
        FROM told t JOIN verdicts v USING (seq) WHERE held GROUP BY t.label""",
        _WORD_MODEL,
    ),
    "union_sources": _sql(
        "SELECT ticker, date, close, volume FROM ("
        + " UNION ALL ".join(
            f"""SELECT lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS ticker, CAST(l_shipdate AS DATE) AS date,
            CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE)
              / CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) AS close,
            CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
            FROM lineitem WHERE l_linestatus = '{status}' GROUP BY 1, 2"""
            for status in ("O", "F")
        )
        + ")"
    ),
    "history_gate": _sql(
        "SELECT ticker, date, volume FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM serve_bars) "
        "WHERE n >= 85"
    ),
    "parse_amount": _sql('SELECT ticker, "year", account, amount_raw, amount FROM amounts'),
    "inf_to_null": _sql(
        'SELECT ticker, "year", account, round(CASE WHEN amount > 0 THEN 1 / amount * 1000000 END, 9) + 0.0 AS inverse '
        "FROM amounts"
    ),
    "market_cap": _sql(
        "SELECT ticker, date, close * shares / CAST(100000000 AS DOUBLE) AS market_cap_eok "
        "FROM bars JOIN tradable USING (ticker)"
    ),
    "listing_code_join": _sql("SELECT ticker, name, shares, corp_code FROM tradable JOIN code_map USING (ticker)"),
    "distinct_codes": _sql("SELECT DISTINCT corp_code FROM tradable JOIN code_map USING (ticker)"),
    "statements_pivot": _sql(f'SELECT ticker, "year", {_r(3, "net_income", "total_equity")} FROM pivoted'),
    "fundamentals_complete": _sql(
        "SELECT ticker, count(DISTINCT year(date)) AS years FROM complete_bars GROUP BY ticker"
    ),
    "ffill_bfill": _sql(
        f"""SELECT DISTINCT ticker, CAST(year(date) AS INTEGER) AS "year", {_r(3, "net_income", "total_equity")}
        FROM complete_bars"""
    ),
    "bars_fundamentals": _sql(f"SELECT ticker, date, {_r(3, 'net_income', 'total_equity')} FROM complete_bars"),
    "valuation_history": _sql(
        "SELECT ticker, date, market_cap, per, pbr, roe FROM history", HISTORY
    ),
    "valuation_latest": _sql(
        "SELECT ticker, name, date, last_close, market_cap_eok, per, pbr, roe FROM valued"
    ),
    **{
        name: _sql(
            f"SELECT ticker, date, round(close / nullif(lag(close, {rows}) OVER "
            f"(PARTITION BY ticker ORDER BY date), 0) - 1, 6) + 0.0 AS {name} FROM bars"
        )
        for name, rows in (("ret_20", 20), ("ret_60", 60))
    },
    "vol_20": _sql(
        """SELECT ticker, date, round(CASE WHEN count(close) OVER m = 20
          THEN stddev_samp(close) OVER m / nullif(avg(close) OVER m, 0) END, 6) + 0.0 AS vol_20
        FROM bars WINDOW m AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
    ),
    "rsi_14": _sql(
        f"SELECT ticker, date, {_r(6, 'rsi_14')} FROM numbered JOIN indicators USING (ticker, i)",
        NUMBERED,
        indicators("numbered"),
    ),
    "macd": _sql(
        f"SELECT ticker, date, {_r(3, 'macd', 'macd_signal', 'macd_hist')} "
        "FROM numbered JOIN indicators USING (ticker, i)",
        NUMBERED,
        indicators("numbered"),
    ),
    "label_up5": _sql(
        "SELECT ticker, date, CAST(coalesce(lead(close, 20) OVER (PARTITION BY ticker ORDER BY date) "
        "/ nullif(close, 0) > CAST(1.05 AS DOUBLE), false) AS INTEGER) AS target FROM bars"
    ),
    "latest_bar": _sql(
        "SELECT ticker, date, close, volume FROM bars "
        "QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1"
    ),
    "pct_min_rank": _sql(
        "SELECT ticker, date, rank() OVER (ORDER BY volume) AS min_rank, "
        "rank() OVER (ORDER BY volume) / CAST(count(volume) OVER () AS DOUBLE) AS pct FROM bars"
    ),
    "pct_min_rank_nulls_last": _sql(
        """SELECT ticker, date, rank() OVER (ORDER BY r ASC NULLS LAST) AS min_rank,
          rank() OVER (ORDER BY r ASC NULLS LAST) / CAST(count(*) OVER () AS DOUBLE) AS pct
        FROM (SELECT ticker, date, round(close / nullif(lag(close, 20) OVER (PARTITION BY ticker ORDER BY date), 0) - 1,
                                         9) AS r FROM bars)"""
    ),
    **{
        name: _sql(f"SELECT ticker, {_r(6, name)} FROM raw_scores", _PLAIN)
        for name in ("value_score", "quality_score", "momentum_score", "volatility_score")
    },
    "feature_medians": _sql(
        " UNION ALL ".join(f"SELECT '{m}' AS measure, round(median({m}), 4) + 0.0 AS median FROM history" for m in MEASURES),
        HISTORY,
    ),
    "impute_median": _sql(f"SELECT ticker, {_r(6, *MEASURES[:6])} FROM imputed"),
    "factor_scores": _sql(f"SELECT ticker, name, last_close, market_cap_eok, {_SCORES} FROM scored", _IMPUTED),
    "score_pred_left_join": _sql(
        "SELECT ticker, name, value_score, CASE WHEN ret_20 > 0 THEN CAST(1 AS DOUBLE) END AS ml_pred_proba FROM scored",
        _IMPUTED,
    ),
    "blend_raw": _sql("SELECT ticker, round(blend, 6) AS blend FROM blended", _IMPUTED),
    "minmax_scale": _sql(
        "SELECT ticker, round(full_score, 6) + 0.0 AS scaled FROM ranked", _IMPUTED, ranking("blend")
    ),
    "final_rank": _sql(
        """SELECT bar, volume, row_number() OVER (ORDER BY volume DESC, bar) AS final_rank
        FROM (SELECT ticker || '@' || CAST(date AS VARCHAR) AS bar, volume FROM bars)"""
    ),
    "final_ranking": _sql(
        f"SELECT ticker, name, last_close, market_cap_eok, {_SCORES}, final_score, final_rank FROM ranked",
        _IMPUTED,
        ranking("blend"),
    ),
    "display_projection": _sql(
        """SELECT final_rank, name, last_close AS last_close_won, final_score AS final_score_points,
          rule * 100 AS up_probability_pct, momentum_score AS momentum_points, value_score AS value_points,
          quality_score AS quality_points, supply_score AS supply_points, volatility_score AS volatility_points,
          market_cap_eok
        FROM ranked""",
        _IMPUTED,
        ranking("round(blend + rule * 0.2, 9)"),
    ),
    "training_rows": _sql(f"SELECT ticker, date, {_r(4, *MEASURES)}, target FROM rows_", HISTORY),
    "class_shares": _sql(
        "SELECT target, count(*) AS rows, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) + 0.0 AS share "
        "FROM rows_ GROUP BY target",
        HISTORY,
    ),
    "stratified_split_sizes": _sql(
        """SELECT target, place <= floor(CAST(0.3 AS DOUBLE) * n + 0.5) AS is_test, count(*) AS rows, min(date) AS first_date
        FROM (SELECT target, date, count(*) OVER (PARTITION BY target) AS n,
                     row_number() OVER (PARTITION BY target
                       ORDER BY md5('42|' || ticker || '|' || CAST(date AS VARCHAR)), ticker, date) AS place
              FROM rows_)
        GROUP BY 1, 2""",
        HISTORY,
    ),
    "classification_report": _sql(
        """, counts AS (
          SELECT t AS class, count(*) FILTER (WHERE target = t AND prediction = t) AS hit,
                 count(*) FILTER (WHERE prediction = t) AS said, count(*) FILTER (WHERE target = t) AS support
          FROM ruled, (SELECT 0 AS t UNION ALL SELECT 1) GROUP BY t),
        per_class AS (
          SELECT CAST(class AS VARCHAR) AS class, coalesce(hit / nullif(said, 0), 0) AS precision,
                 coalesce(hit / nullif(support, 0), 0) AS recall,
                 coalesce(2 * hit / nullif(said + support, 0), 0) AS f1, support, hit
          FROM counts),
        lines AS (
          SELECT class, precision, recall, f1, support FROM per_class
          UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support)
          FROM per_class
          UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per_class
          UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                           sum(f1 * support) / sum(support), sum(support) FROM per_class)
        SELECT class, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1,
               CAST(support AS BIGINT) AS support FROM lines""",
        HISTORY,
    ),
    "roc_auc": _sql(
        """, placed AS (
          SELECT target, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS place FROM ruled),
        sums AS (SELECT sum(target) AS p, sum(1 - target) AS n, sum(place * target) AS s FROM placed)
        SELECT CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives,
               round((CAST(s AS DOUBLE) - CAST(p AS DOUBLE) * (p + 1) / 2) / (CAST(p AS DOUBLE) * n), 6) + 0.0 AS auc
        FROM sums""",
        HISTORY,
    ),
    "smote_balance": _sql(
        """, counted AS (SELECT target, count(*) AS n FROM rows_ GROUP BY target), ends AS (SELECT min(n) AS few, max(n) AS many FROM counted)
        SELECT target, false AS synthetic, n AS rows FROM counted
        UNION ALL SELECT target, true, many - few FROM counted, ends WHERE n = few AND few < many""",
        HISTORY,
    ),
    "top_market_cap": _sql(_LAST_CLOSES),
    "minmax_by_ticker": _sql(f"SELECT ticker, date, {_r(6, 'scaled')} FROM scaled_bars", SAMPLES),
    "sequences_60": _sql(
        "SELECT ticker, date, CAST(length AS INTEGER) AS length, round(first_value, 6) + 0.0 AS first_value, round(scaled, 6) + 0.0 AS last_value, "
        "round(total, 6) + 0.0 AS total FROM samples",
        SAMPLES,
    ),
    "sequence_label": _sql(
        "SELECT ticker, date, CAST(later > scaled AS INTEGER) AS target FROM samples", SAMPLES
    ),
    "tail_split": _sql(
        """SELECT ticker, date, position, position > floor(n * CAST(0.9 AS DOUBLE)) AS is_tail
        FROM (SELECT ticker, date, row_number() OVER (ORDER BY ticker, date) AS position, count(*) OVER () AS n FROM samples)""",
        SAMPLES,
    ),
    "latest_headlines": _sql("SELECT ticker, CAST(rn AS INTEGER) AS rn, seq, title FROM latest_news"),
    "headline_labels": _sql(
        f"""SELECT ticker, seq, CASE WHEN up > down THEN 'positive' WHEN down > up THEN 'negative' ELSE 'neutral' END AS label,
          round(coalesce(greatest(up, down) / nullif(up + down, 0), 1), 6) + 0.0 AS score
        FROM (SELECT ticker, seq, len(regexp_extract_all(regexp_replace(lower(title), '[^a-z]', '  ', 'g'), '(^| )({_UP})(s|es|ed|ing)?($| )')) AS up,
                     len(regexp_extract_all(regexp_replace(lower(title), '[^a-z]', '  ', 'g'), '(^| )({_DOWN})(s|es|ed|ing)?($| )')) AS down FROM headlines)"""
    ),
    "sentiment_points": _sql(
        """SELECT ticker, seq, round(CASE label WHEN 'neutral' THEN 50 WHEN 'positive' THEN 50 + score * 50
                                     WHEN 'negative' THEN 50 - score * 50 END, 6) + 0.0 AS points FROM headlines"""
    ),
    "sentiment_score": _sql(
        """SELECT ticker, round_even(coalesce(points, 50) * 100, 0) / 100 AS sentiment_score
        FROM listing LEFT JOIN (
          SELECT ticker, avg(CASE label WHEN 'neutral' THEN 50 WHEN 'positive' THEN 50 + score * 50
                             WHEN 'negative' THEN 50 - score * 50 END) AS points
          FROM latest_news GROUP BY ticker) USING (ticker)"""
    ),
    "headlines_joined": _sql(
        """SELECT ticker, coalesce(titles, '최신 뉴스 없음') AS headlines
        FROM listing LEFT JOIN (
          SELECT ticker, string_agg(title, ' | ' ORDER BY rn) AS titles FROM latest_news GROUP BY ticker) USING (ticker)"""
    ),
}
