"""DuckDB SQL that replays the parser over `pages` on its own: tokens by one regular expression, the open elements as a list
carried by a recursive query. It covers what pages contain, and is only there to check results."""

from __future__ import annotations

_TOKEN = r"(?s)<!--.*?-->|<![^>]*>|<(?:script|style|title)>.*?</(?:script|style|title)>|</?[a-zA-Z][^>]*>|[^<]+"
_P = "['p','hr','h1','h2','h3','h4','h5','h6','dl','ol','ul','div','nav','pre','form','main','aside','table','footer','header','address','article','section','fieldset','blockquote']"
_VOID = "['area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr']"


def nodes_sql(drop_ws: bool = True) -> str:
    """WITH RECURSIVE ... up to CTEs `nodes` (all nodes) and `el` (elements with sibling places)."""
    skip = r"regexp_full_match(t, '[ \n\r\t\f]*')" if drop_ws else "false"
    return rf"""
WITH RECURSIVE tok AS (
  SELECT page_id, CAST(unnest(range(1, len(a) + 1)) AS BIGINT) AS pos, unnest(a) AS t FROM (SELECT page_id, regexp_extract_all(html, '{_TOKEN}') AS a FROM pages)),
kinds AS (
  SELECT *, CASE WHEN t LIKE '<!%' THEN 'skip' WHEN t LIKE '</%' THEN 'close' WHEN t LIKE '<%' THEN 'open' WHEN {skip} THEN 'skip' ELSE 'text' END AS k,
    lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS nm FROM tok),
steps AS (SELECT *, k = 'open' AND nm IN ('script', 'style', 'title') AS rawtext, list_contains({_VOID}, nm) AS void FROM kinds),
walk AS (
  SELECT page_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS last, CAST([0] AS BIGINT[]) AS stk, CAST([''] AS VARCHAR[]) AS nms,
    CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS ep, CAST(NULL AS BIGINT) AS ed, CAST('' AS VARCHAR) AS ek, CAST('' AS VARCHAR) AS en, CAST('' AS VARCHAR) AS et, false AS er FROM pages
  UNION ALL
  SELECT page_id, pos, CASE WHEN k = 'open' AND rawtext THEN last + 2 WHEN k IN ('open', 'text') THEN last + 1 ELSE last END,
    CASE WHEN k = 'open' AND NOT rawtext AND NOT void THEN list_append(s1, last + 1) WHEN k = 'close' AND cut > 1 THEN stk[1:cut - 1] ELSE s1 END,
    CASE WHEN k = 'open' AND NOT rawtext AND NOT void THEN list_append(n1, nm) WHEN k = 'close' AND cut > 1 THEN nms[1:cut - 1] ELSE n1 END,
    CASE WHEN k IN ('open', 'text') THEN last + 1 END, s1[len(s1)], CAST(len(s1) AS BIGINT), k, nm, t, rawtext
  FROM (SELECT *, CASE WHEN ic THEN stk[1:len(stk) - 1] ELSE stk END AS s1, CASE WHEN ic THEN nms[1:len(nms) - 1] ELSE nms END AS n1,
      coalesce(list_max(list_filter(range(1, len(nms) + 1), lambda i: nms[i] = nm)), 0) AS cut
    FROM (SELECT s.*, w.last, w.stk, w.nms, s.k = 'open' AND (
        (w.nms[len(w.nms)] = 'p' AND list_contains({_P}, s.nm)) OR (w.nms[len(w.nms)] = 'li' AND s.nm = 'li') OR (w.nms[len(w.nms)] = 'head' AND s.nm = 'body')) AS ic
      FROM walk w JOIN steps s ON s.page_id = w.page_id AND s.pos = w.pos + 1))),
flat AS (
  SELECT page_id, 0 AS idx, 'document' AS kind, '' AS tag, CAST(NULL AS BIGINT) AS parent, 0 AS depth, '' AS t FROM pages
  UNION ALL SELECT page_id, e, CASE WHEN ek = 'open' THEN 'element' ELSE 'text' END, CASE WHEN ek = 'open' THEN en END, ep, ed, CASE WHEN er THEN '<' || en || '>' ELSE et END FROM walk WHERE e IS NOT NULL
  UNION ALL SELECT page_id, e + 1, 'text', NULL, e, ed + 1, et[length(en) + 3:length(et) - length(en) - 3] FROM walk WHERE er),
nodes AS MATERIALIZED (
  SELECT a.page_id, a.idx, a.kind, a.tag, a.parent, a.depth, a.t, coalesce(min(b.idx) - 1, any_value(m.top)) AS fin,
    CASE WHEN a.kind = 'text' THEN replace(replace(replace(replace(replace(a.t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') END AS txt
  FROM flat a JOIN (SELECT page_id, max(idx) AS top FROM flat GROUP BY page_id) m ON m.page_id = a.page_id
    LEFT JOIN flat b ON b.page_id = a.page_id AND b.idx > a.idx AND b.depth <= a.depth GROUP BY ALL),
el AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER s AS BIGINT) AS sib, lag(idx) OVER s AS prev, lead(idx) OVER s AS nxt FROM nodes WHERE kind = 'element'
  WINDOW s AS (PARTITION BY page_id, parent ORDER BY idx)),
att AS MATERIALIZED (SELECT *, CASE WHEN t LIKE '% href="%' THEN regexp_extract(t, ' href="([^"]*)"', 1) END AS href,
    CASE WHEN t LIKE '% lang="%' THEN regexp_extract(t, ' lang="([^"]*)"', 1) END AS lang, CASE WHEN t LIKE '% class="%' THEN regexp_extract(t, ' class="([^"]*)"', 1) END AS class FROM el)
"""


NODES, STRICT = nodes_sql(), nodes_sql(False)
NORMAL = r"trim(regexp_replace({}, '[ \n\r\t\f]+', ' ', 'g'), ' ')"
