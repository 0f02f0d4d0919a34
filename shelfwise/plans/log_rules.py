"""Queries on override logs and on similar texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import names, overrides, similar
from ..sources.views import table
from . import sql
from .catalog import _texts, query

c = F.col

#: Sessions of families and their log, from parts and events; the same expressions in the SQL.
_MEMBERS = """SELECT 'S' || p_partkey % 8 AS session, p_partkey::VARCHAR AS key, CASE WHEN p_partkey % 11 <> 0 THEN 'F' || p_partkey % 40 END AS family_id FROM part"""
_LOG = """SELECT 'S' || user_id % 8 AS session, event_id AS seq, CASE event_type WHEN 'error' THEN 'undo' WHEN 'purchase' THEN 'merge' WHEN 'signup' THEN 'split' ELSE 'move' END AS action, user_id::VARCHAR AS key, 'F' || event_id % 40 AS source,
    CASE event_type WHEN 'view' THEN 'standalone' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'standalone' ELSE 'new_family' END WHEN 'purchase' THEN 'F' || (event_id * 7 + 1) % 40 ELSE 'F' || event_id % 13 END AS target,
    [user_id::VARCHAR, (user_id + 8)::VARCHAR, (user_id + 16)::VARCHAR] AS keys FROM events WHERE event_type <> 'purchase' OR event_id % 40 <> (event_id * 7 + 1) % 40"""
#: Each session's log step by step, with what stands as a stack.
_STANDS = f"""l AS ({_LOG}), e AS (SELECT session, seq, action, row_number() OVER (PARTITION BY session ORDER BY seq) AS i FROM l),
    r AS (SELECT session, 0::BIGINT AS i, []::BIGINT[] AS held FROM (SELECT DISTINCT session FROM e) UNION ALL SELECT r.session, e.i, CASE WHEN e.action = 'undo' THEN r.held[:-2] ELSE list_append(r.held, e.seq) END
        FROM r JOIN e ON e.session = r.session AND e.i = r.i + 1), h AS (SELECT session, unnest(arg_max(held, i)) AS seq FROM r GROUP BY 1), st AS (SELECT l.* FROM l JOIN h USING (session, seq))"""


def _log(spark, sf):
    kind, at, k = c("event_type"), c("event_id"), lambda x: x.cast("string")
    numbered = lambda x: F.concat(F.lit("F"), k(x))
    action = F.when(kind == "error", "undo").when(kind == "purchase", "merge").when(kind == "signup", "split").otherwise("move")
    target = F.when(kind == "view", "standalone").when(kind == "signup", F.when(at % 2 == 0, "standalone").otherwise("new_family")).when(kind == "purchase", numbered((at * 7 + 1) % 40)).otherwise(numbered(at % 13))
    user = c("user_id")
    rows = table(spark, sf, "events").filter((kind != "purchase") | (at % 40 != (at * 7 + 1) % 40))
    return rows.select(
        F.concat(F.lit("S"), k(user % 8)).alias("session"), at.cast("long").alias("seq"), action.alias("action"), k(user).alias("key"), numbered(at % 40).alias("source"), target.alias("target"), F.array(k(user), k(user + 8), k(user + 16)).alias("keys")
    )


@query(f"WITH RECURSIVE {_STANDS} SELECT session, seq, action FROM st")
def q_overrides_standing(spark, sf):
    """Overrides that no undo reverses."""
    return overrides.standing(_log(spark, sf)).select("session", "seq", "action")


@query(f"""WITH RECURSIVE {_STANDS}, m AS ({_MEMBERS}),
    p AS (SELECT session, key, seq, CASE WHEN target <> 'standalone' THEN target END AS fam FROM st WHERE action = 'move' UNION ALL SELECT session, unnest(keys), seq, CASE WHEN target <> 'standalone' THEN 'FAM-' || substr(sha256('manual-split-' || source || '-' || array_to_string(list_sort(keys), '-')), 1, 16) END FROM st WHERE action = 'split'),
    lp AS (SELECT session, key, max(seq) AS seq, arg_max([fam], seq)[1] AS fam FROM p GROUP BY 1, 2),
    w AS (SELECT m.session, m.key, CASE WHEN lp.seq IS NULL THEN m.family_id ELSE lp.fam END AS fam, coalesce(lp.seq, -1) AS seq, lp.seq IS NOT NULL AS moved FROM m LEFT JOIN lp USING (session, key)
        UNION ALL SELECT w.session, w.key, g.target, g.seq, TRUE FROM w JOIN st g ON g.session = w.session AND g.action = 'merge' AND g.source = w.fam AND g.seq > w.seq
            WHERE NOT EXISTS (SELECT 1 FROM st x WHERE x.session = w.session AND x.action = 'merge' AND x.source = w.fam AND x.seq > w.seq AND x.seq < g.seq))
    SELECT session, key, arg_max([fam], seq)[1] AS family_id, arg_max(moved, seq) AS moved FROM w GROUP BY 1, 2""")
def q_overrides_settled(spark, sf):
    """Members of families after a log of moves, merges, splits and undos."""
    members = table(spark, sf, "part").select(
        F.concat(F.lit("S"), (c("p_partkey") % 8).cast("string")).alias("session"), c("p_partkey").cast("string").alias("key"), F.when(c("p_partkey") % 11 != 0, F.concat(F.lit("F"), (c("p_partkey") % 40).cast("string"))).alias("family_id")
    )
    return overrides.settled(members, _log(spark, sf))


@query(f"""WITH d AS (SELECT doc_id, list_distinct({sql.words('text')}) AS a FROM documents), b AS (SELECT item_id, list_distinct({sql.words('text')}) AS b FROM benchmark),
    s AS (SELECT doc_id, item_id, len(list_intersect(a, b)) AS n, len(a) + len(b) AS total FROM d, b WHERE len(a) > 0 AND len(b) > 0) SELECT doc_id, item_id, n::DOUBLE / (total - n) AS similarity FROM s WHERE n::DOUBLE / (total - n) >= 0.2""")
def q_similar_texts(spark, sf):
    """Documents and benchmark items of which a fifth of all words or more are shared."""
    return similar.similar_texts(_texts(spark, sf), table(spark, sf, "benchmark"), 0.2, "doc_id", "item_id")


@query("""WITH b AS (SELECT DISTINCT lower(string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] || ' ' || string_split(text, ' ')[3]) AS name FROM benchmark), d AS (SELECT doc_id, lower(text) AS t FROM documents)
    SELECT doc_id, name, ((length(t) - length(replace(t, name, ''))) / length(name))::BIGINT AS n, (strpos(t, name) - 1)::INTEGER AS first_at FROM d, b WHERE contains(t, name)""")
def q_names_in_texts(spark, sf):
    """The first three words of each benchmark item as names: how often, and from where on, each document has them."""
    words = F.split("text", " ")
    known = table(spark, sf, "benchmark").filter(F.size(words) >= 3).select(F.array_join(F.slice(words, 1, 3), " ").alias("name"))
    return names.counts(_texts(spark, sf), known, "doc_id", "text", "name")
