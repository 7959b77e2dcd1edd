"""Live-record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantframe.catalog.ledger_sql import BOOK
from quantframe.catalog.registry import query
from quantframe.sources.testdata import INITIAL_CASH
from quantframe.operators import ledger, live

SIDES = {
    "col_f": """select session, symbol, quantity > 0 as buying, sum(quantity) as quantity,
                  sum(abs(quantity) * price) / sum(abs(quantity)) as price,
                  sum(commission) as commission, count(*) as pieces
                from fills where venue = 'F' group by 1, 2, 3""",
    "col_o": """select session, symbol, quantity > 0 as buying, sum(quantity) as quantity,
                  sum(abs(quantity) * price) / sum(abs(quantity)) as price,
                  sum(commission) as commission, count(*) as pieces
                from fills where venue = 'O' group by 1, 2, 3""",
    "both_sides": """select f.session, f.symbol, f.buying, f.price as sim_price,
                   o.price as act_price, (o.price - f.price) / f.price * 10000
                     * case when f.buying then 1 else -1 end as divergence_bps,
                   (o.commission - f.commission) / (abs(o.quantity) * o.price) * 10000
                     as commission_bps
                 from col_f f join col_o o on f.session = o.session and f.symbol = o.symbol
                   and f.buying = o.buying""",
}


def two_sides(t):
    return (
        live.collapse_fills(t.fills.filter("venue = 'F'")),
        live.collapse_fills(t.fills.filter("venue = 'O'")),
    )


@query(
    "L01_collapse_fills",
    "portfolio:s session:d symbol:s buying:b quantity:f price:f commission:m pieces:l",
    """select portfolio, session, symbol, quantity > 0 as buying, sum(quantity) as quantity,
         sum(abs(quantity) * price) / sum(abs(quantity)) as price, sum(commission) as commission,
         count(*) as pieces from fills group by 1, 2, 3, 4""",
)
def _(t):
    return live.collapse_fills(t.fills, ["portfolio"])


@query(
    "L02_fill_divergence",
    "pairs:l median_bps:f mean_bps:f worst_bps:f improved:l commission_bps:f modelled_bps:f"
    " optimism:f corrected_scale:f trustworthy:b unmatched_simulated:l unmatched_actual:l",
    """select *, floor(optimism * 1e4 + 0.5e0) / 1e4 as corrected_scale from (
         select count(*) as pairs, median(divergence_bps) as median_bps,
           avg(divergence_bps) as mean_bps, max(divergence_bps) as worst_bps,
           sum(case when divergence_bps < 0 then 1 else 0 end) as improved,
           avg(commission_bps) as commission_bps,
           avg(coalesce(half_spread_bps, 2)) as modelled_bps,
           greatest(median(divergence_bps), 0) / avg(coalesce(half_spread_bps, 2)) as optimism,
           count(*) >= 30 as trustworthy,
           (select count(*) from col_f) - count(*) as unmatched_simulated,
           (select count(*) from col_o) - count(*) as unmatched_actual
         from both_sides left join instruments using (symbol)) t""",
    SIDES,
)
def _(t):
    simulated, actual = two_sides(t)
    return live.divergence_summary(
        live.paired_intentions(simulated, actual),
        live.unmatched(simulated, actual),
        t.instruments,
    )


def execution_feed(t):
    """The fill feed with repeats: rows at the zero tax band arrive twice, those at the two
    percent band arrive again with another price."""
    cols = ["execution_id", "order_id", "symbol", "ts", "quantity", "price", "commission"]
    cols += ["slippage", "tax"]
    base = t.fills.select(*cols)
    again = base.filter("tax = 0.0")
    changed = base.filter("tax = 0.02").withColumn("price", F.col("price") + 0.5)
    return base.unionByName(again).unionByName(changed)


@query(
    "L03_dedupe_executions",
    "execution_id:s copies:l verdict:s",
    """select execution_id, count(*) as copies,
         case when count(distinct price) > 1 then 'conflict' when count(*) > 1 then 'repeat'
              else 'new' end as verdict
       from (select execution_id, price from fills
             union all select execution_id, price from fills where tax = 0.0
             union all select execution_id, price + 0.5 from fills where tax = 0.02) u
       group by 1""",
)
def _(t):
    return live.execution_verdicts(
        execution_feed(t),
        ["order_id", "symbol", "ts", "quantity", "price", "commission", "slippage"],
    )


@query(
    "L03_correction_review",
    "prefix:s versions:l",
    """select concat('E', cast(l_orderkey as varchar), '.', cast(l_partkey as varchar)) as prefix,
              count(distinct l_linenumber) as versions
       from lineitem group by 1 having count(distinct l_linenumber) > 1""",
)
def _(t):
    ids = t.raw("lineitem").selectExpr(
        "concat('E', cast(l_orderkey as string), '.', cast(l_partkey as string), '.',"
        " cast(l_linenumber as string)) as execution_id"
    )
    return live.correction_review(ids)


@query(
    "L05_order_completion",
    "order_id:s quantity:f executed:f status:s",
    """select o.order_id, o.quantity, coalesce(x.executed, 0) as executed,
         case when coalesce(x.executed, 0) = o.quantity then 'complete'
              when coalesce(x.executed, 0) <> 0 then 'partial' else 'none' end as status
       from (select order_id, sum(quantity) as quantity from fills group by 1) o
       left join (select order_id, sum(quantity) as executed from fills where venue = 'F'
                  group by 1) x using (order_id)""",
)
def _(t):
    orders = t.fills.groupBy("order_id").agg(F.sum("quantity").alias("quantity"))
    return live.order_completion(orders, t.fills.filter("venue = 'F'"))


EFFECTIVE = """select f.execution_id, f.symbol, coalesce(a.ts, f.ts) as ts, f.quantity,
                 coalesce(a.price, f.price) as price,
                 coalesce(a.commission, f.commission) as commission,
                 coalesce(a.slippage, f.slippage) as slippage, a.import_id,
                 a.execution_id is not null as amended
               from fills f left join (select * from amendments where version = 2) a
                 on a.execution_id = f.execution_id"""


@query(
    "L08_effective_fills",
    "execution_id:s symbol:s ts:t quantity:f price:f commission:m slippage:m import_id:s amended:b",
    EFFECTIVE,
)
def _(t):
    return live.effective_fills(t.fills, t.amendments)


@query(
    "L08_ledger_vs_statement",
    "portfolio:s movement:m calculated:m explained:b",
    """select portfolio, ending as movement, calc as calculated, abs(calc - ending) <= 0.01
              as explained
       from (select portfolio, sum(-quantity * price - commission) as calc from fills group by 1) a
       join (select portfolio, sum(-quantity * price - commission)
               + case when portfolio = 'P3' then 5 else 0 end as ending
             from fills group by 1) b using (portfolio)""",
)
def _(t):
    reported = t.fills.groupBy("portfolio").agg(
        F.sum(-F.col("quantity") * F.col("price") - F.col("commission")).alias("ending_cash")
    ).select(
        "portfolio",
        F.lit(0.0).alias("starting_cash"),
        (F.col("ending_cash") + F.when(F.col("portfolio") == "P3", 5.0).otherwise(0.0)).alias(
            "ending_cash"
        ),
    )
    return live.ledger_vs_statement(t.fills, reported)


POSITIONS_BOTH = """
select coalesce(e.portfolio, a.portfolio) as portfolio, coalesce(e.symbol, a.symbol) as symbol,
       coalesce(e.q, 0) as expected, coalesce(a.q, 0) as actual,
       coalesce(a.q, 0) - coalesce(e.q, 0) as difference,
       abs(coalesce(a.q, 0) - coalesce(e.q, 0)) <= 1e-8 as agrees
from (select portfolio, symbol, sum(quantity) as q from fills group by 1, 2) e
full outer join (select portfolio, symbol, sum(quantity) as q from fills
                 where not (symbol = 'S03' and tax = 0.01) group by 1, 2) a
  on a.portfolio = e.portfolio and a.symbol = e.symbol"""


def both_positions(t):
    total = lambda df: df.groupBy("portfolio", "symbol").agg(
        F.sum("quantity").alias("quantity")
    )
    return live.reconcile(
        total(t.fills), total(t.fills.filter("not (symbol = 'S03' and tax = 0.01)"))
    )


@query(
    "L09_reconcile_positions",
    "portfolio:s checked:l discrepancies:l agreed:b",
    f"""select portfolio, count(*) as checked,
               sum(case when agrees then 0 else 1 end) as discrepancies, bool_and(agrees) as agreed
        from ({POSITIONS_BOTH}) r group by 1""",
)
def _(t):
    return live.reconciliation_summary(both_positions(t))


@query(
    "L10_failure_streak",
    "user_id:l event_id:l failed:b streak:l event:s",
    """select user_id, event_id, failed, case when failed then run else 0 end as streak,
         case when failed and run = 3 then 'alert'
              when not failed and coalesce(prev, 0) >= 3 then 'recovered' else 'ok' end as event
       from (select *, lag(case when failed then run else 0 end) over
               (partition by user_id order by ts, event_id) as prev
             from (select *, row_number() over (partition by user_id, island, failed
                       order by ts, event_id) as run
                   from (select user_id, ts, event_id, event_type = 'error' as failed,
                           sum(case when event_type = 'error' then 0 else 1 end) over
                             (partition by user_id order by ts, event_id) as island
                         from events) a) b) c""",
)
def _(t):
    events = t.raw("events").select("user_id", "ts", "event_id", "event_type")
    return live.failure_streaks(
        events, "user_id", "ts", F.col("event_type") == "error", "event_id"
    )


@query(
    "L11_stalled_fund",
    "portfolio:s session:d orders:l fills:l stalled:b",
    """select coalesce(o.portfolio, f.portfolio) as portfolio, coalesce(o.session, f.session) as session,
         coalesce(o.n, 0) as orders, coalesce(f.n, 0) as fills,
         coalesce(o.n, 0) > 0 and coalesce(f.n, 0) = 0 as stalled
       from (select portfolio, cast(created_at as date) as session, count(*) as n
             from order_book group by 1, 2) o
       full outer join (select portfolio, session, count(*) as n from fills
                        where venue = 'F' group by 1, 2) f
         on f.portfolio = o.portfolio and f.session = o.session""",
)
def _(t):
    orders = t.order_book.select("portfolio", F.to_date("created_at").alias("session"))
    return live.stalled(orders, t.fills.filter("venue = 'F'"), ["portfolio", "session"])


@query(
    "L12_latest_pending",
    "portfolio:s order_id:s saved_at:d explained:b",
    """select p.portfolio, p.order_id, p.saved_at, e.order_id is not null as explained
       from (select portfolio, order_id, session as saved_at,
               max(session) over (partition by portfolio) as newest from fills) p
       left join (select distinct order_id from fills where venue = 'F') e using (order_id)
       where saved_at = newest""",
)
def _(t):
    pending = t.fills.select("portfolio", "order_id", F.col("session").alias("saved_at"))
    return live.latest_pending(pending, t.fills.filter("venue = 'F'"))


@query(
    "L13_redact_documents",
    "doc_id:l redacted:s",
    r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
          text, '\b(?:DU[T]?|U)\d+\b', '[ACCOUNT]', 'gi'),
          '[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'),
          'https://hc-ping\.com/[\w-]+(?:/\w+)?', '[HEALTHCHECK_URL]', 'g'),
          '\b(?:re|gh[pousr]|github_pat)_[A-Za-z0-9_\-]{12,}\b', '[TOKEN]', 'g'),
          '(\b(?:jxBrowserKey|TWS_USERID|password|api_key|token|restart|IbLoginId|FIXLoginId)\s*[=:]\s*)[^\s,;]+',
          '\1[REDACTED]', 'gi') as redacted
        from documents""",
)
def _(t):
    return t.raw("documents").select("doc_id", live.redact_text("text").alias("redacted"))


@query(
    "L13_redact_conversations",
    "conv_id:s turn:l redacted:s",
    r"""select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
          regexp_replace(text, '\b(?:DU[T]?|U)\d+\b', '[ACCOUNT]', 'gi'),
          '[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'),
          'https://hc-ping\.com/[\w-]+(?:/\w+)?', '[HEALTHCHECK_URL]', 'g'),
          '\b(?:re|gh[pousr]|github_pat)_[A-Za-z0-9_\-]{12,}\b', '[TOKEN]', 'g'),
          '(\b(?:jxBrowserKey|TWS_USERID|password|api_key|token|restart|IbLoginId|FIXLoginId)\s*[=:]\s*)[^\s,;]+',
          '\1[REDACTED]', 'gi') as redacted
        from conversations""",
)
def _(t):
    return t.raw("conversations").select(
        "conv_id", "turn", live.redact_text("text").alias("redacted")
    )
