"""DuckDB SQL oracles for the registered queries (see ``catalog``).

Written independently of the Spark code: paths are taken apart with
``split_part`` / ``string_split`` and matched with ``LIKE``; rule effects are
spelled out for the fixed rule tables of ``catalog``.
"""

from __future__ import annotations

import re

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def fold(expr: str) -> str:
    return f"translate({expr}, '{UPPER}', '{LOWER}')"


def _name(expr: str) -> str:
    return f"(string_split({expr}, '/'))[-1]"


def _parent(expr: str) -> str:
    return f"regexp_replace({expr}, '/[^/]*$', '')"


def _dirs(name: str, files: str) -> str:
    """Proper ancestors (without the root) of every path in ``files``."""
    return f"""{name} AS (
  SELECT DISTINCT array_to_string(list_slice(parts, 1, k), '/') AS path FROM (
    SELECT parts, unnest(generate_series(2, len(parts) - 1)) AS k
    FROM (SELECT string_split(path, '/') AS parts FROM {files})))"""


SRC_FILES = """src_files AS (
  SELECT '/lake/' || source || '/' || lang || '/' || (CASE WHEN doc_id % 17 = 0 THEN '.' ELSE '' END)
         || 'doc' || CAST(doc_id AS VARCHAR)
         || (CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.json' WHEN 3 THEN '.tmp' ELSE '.log' END) AS path,
         false AS is_dir, CAST(strlen(text) AS BIGINT) AS size,
         make_timestamp(CAST(1704067200000000 + doc_id * 1000000 AS BIGINT)) AS mtime,
         sha256(text) AS content_hash, doc_id
  FROM documents)"""

DST_FILES = """dst_files AS (
  SELECT CASE WHEN doc_id % 10 = 4 THEN replace(p0, '/doc', '/old')
              WHEN doc_id % 10 = 6 THEN replace(p0, '/doc', '/stale') ELSE p0 END AS path,
         false AS is_dir,
         CASE WHEN doc_id % 10 = 5 THEN size + 1 WHEN doc_id % 10 = 6 THEN size + 7 ELSE size END AS size,
         make_timestamp(CAST(1704067200000000 + doc_id * 1000000 + (doc_id % 4) * 1000000 AS BIGINT)) AS mtime,
         CASE WHEN doc_id % 10 IN (5, 6) THEN 'x' || content_hash ELSE content_hash END AS content_hash, doc_id
  FROM (SELECT *, '/backup/' || substr(path, 7) AS p0 FROM src_files) WHERE doc_id % 10 <> 3)"""


def _inv(name: str, files: str, dirs: str) -> str:
    return f"""{name} AS (
  SELECT path, is_dir, size, mtime, content_hash FROM {files}
  UNION ALL
  SELECT path, true, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR)
  FROM {dirs} WHERE path NOT IN (SELECT path FROM {files}))"""


BASE = [SRC_FILES, DST_FILES, _dirs("src_dirs", "src_files"), _dirs("dst_dirs", "dst_files"),
        _inv("src_inv", "src_files", "src_dirs"), _inv("dst_inv", "dst_files", "dst_dirs")]

# Claims under the fixed rule tables (read prefix /lake, write prefix /backup).
CLAIMS_FIXTURE = f"""claims AS (
  SELECT 5 AS rule_seq, path FROM m5
  UNION ALL
  SELECT 8, path FROM src_inv WHERE path LIKE '/lake/%' AND NOT path LIKE '/lake/src1/%'
    AND path NOT IN (SELECT path FROM m5))"""
M5 = f"""m5 AS (
  SELECT path FROM src_inv WHERE path LIKE '/lake/%' AND {_name('path')} LIKE '%.md'
    AND NOT (path LIKE '%.tmp' OR path LIKE '%.tmp/%'))"""
CLAIMS_PLAIN = """claims AS (SELECT 2 AS rule_seq, path FROM src_inv WHERE path LIKE '/lake/%')"""
CLAIMS_ORPHAN = """claims AS (
  SELECT 2 AS rule_seq, path FROM src_inv WHERE path = '/lake/src2' OR path LIKE '/lake/src2/%')"""

EXPECTED = """parents AS (
  SELECT DISTINCT rule_seq, array_to_string(list_slice(parts, 1, k), '/') AS path FROM (
    SELECT rule_seq, parts, unnest(generate_series(3, len(parts) - 1)) AS k
    FROM (SELECT rule_seq, string_split(path, '/') AS parts FROM claims))),
tracked_all AS (
  SELECT c.rule_seq, c.path AS read_path, false AS is_parent, i.is_dir, i.size, i.mtime, i.content_hash
  FROM claims c JOIN src_inv i ON i.path = c.path
  UNION ALL
  SELECT rule_seq, path, true, true, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR) FROM parents),
expected AS (
  SELECT *, '/backup/' || substr(read_path, 7) AS write_path, substr(read_path, 7) AS rel_path
  FROM tracked_all
  QUALIFY row_number() OVER (PARTITION BY read_path ORDER BY rule_seq, is_parent) = 1)"""

EXACT_EQ = """CASE WHEN source_path IS NULL OR d_is_dir IS NULL THEN false
                 WHEN s_is_dir OR d_is_dir THEN s_is_dir AND d_is_dir
                 WHEN s_size <> d_size THEN false
                 ELSE COALESCE(s_hash = d_hash, false) END"""
FAST_EQ = """CASE WHEN source_path IS NULL OR d_is_dir IS NULL THEN false
                 WHEN s_is_dir OR d_is_dir THEN s_is_dir AND d_is_dir
                 ELSE COALESCE(abs(epoch_us(s_mtime) - epoch_us(d_mtime)) < 2000000, false) END"""

JUDGED = """actual AS (SELECT * FROM dst_inv WHERE path LIKE '/backup/%'),
pairs AS (
  SELECT COALESCE(e.write_path, a.path) AS dest_path, e.read_path AS source_path,
         e.is_dir AS s_is_dir, e.size AS s_size, e.mtime AS s_mtime, e.content_hash AS s_hash,
         a.is_dir AS d_is_dir, a.size AS d_size, a.mtime AS d_mtime, a.content_hash AS d_hash
  FROM expected e FULL OUTER JOIN actual a ON e.write_path = a.path),
judged AS (SELECT *, {eq} AS equal FROM pairs)"""


def _judged(eq: str = EXACT_EQ, actual: str = "dst_inv WHERE path LIKE '/backup/%'") -> str:
    return JUDGED.replace("dst_inv WHERE path LIKE '/backup/%'", actual).replace("{eq}", eq)


def _fast_walk(changes: str) -> str:
    """The greedy fast-mode pairing stated as the loop itself: additions in
    folded order, each taking the first (segment order) untaken deletion of
    equal size less than 2 s away. Additions with no candidate at all are
    left out first (they can never pair)."""
    return f"""f_adds AS (
  SELECT dest_path, size, epoch_us(mtime) AS t,
         row_number() OVER (ORDER BY {fold('dest_path')}, dest_path) AS ai
  FROM {changes} r WHERE change = 'add' AND NOT is_dir AND mtime IS NOT NULL
    AND EXISTS (SELECT 1 FROM {changes} x WHERE x.change = 'delete' AND NOT x.is_dir AND x.size = r.size
                AND abs(epoch_us(x.mtime) - epoch_us(r.mtime)) < 2000000)),
f_dels AS (
  SELECT dest_path, size, epoch_us(mtime) AS t, row_number() OVER (ORDER BY string_split(dest_path, '/')) AS di
  FROM {changes} WHERE change = 'delete' AND NOT is_dir AND mtime IS NOT NULL),
rpairs AS (
  WITH RECURSIVE w(ai, taken, old_path, new_path, size) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT)
    UNION ALL
    SELECT s.ai, CASE WHEN s.old IS NULL THEN s.taken ELSE list_append(s.taken, s.old) END, s.old, s.new, s.size
    FROM (SELECT a.ai, w.taken, a.dest_path AS new, a.size,
                 (SELECT d.dest_path FROM f_dels d
                  WHERE d.size = a.size AND abs(d.t - a.t) < 2000000 AND NOT list_contains(w.taken, d.dest_path)
                  ORDER BY d.di LIMIT 1) AS old
          FROM w JOIN f_adds a ON a.ai = w.ai + 1) s)
  SELECT old_path, new_path, size FROM w WHERE old_path IS NOT NULL)"""


def _changes(ignored_pred: str, renames: bool | str = True) -> str:
    exact = f"""ra AS (
  SELECT dest_path, size, content_hash,
         row_number() OVER (PARTITION BY size, content_hash ORDER BY {fold('dest_path')}, dest_path) AS rn
  FROM raw_changes WHERE change = 'add' AND NOT is_dir AND size IS NOT NULL AND content_hash IS NOT NULL),
rd AS (
  SELECT dest_path, size, content_hash,
         row_number() OVER (PARTITION BY size, content_hash ORDER BY string_split(dest_path, '/')) AS rn
  FROM raw_changes WHERE change = 'delete' AND NOT is_dir AND size IS NOT NULL AND content_hash IS NOT NULL),
rpairs AS (SELECT rd.dest_path AS old_path, ra.dest_path AS new_path, ra.size FROM ra JOIN rd USING (size, content_hash, rn)),"""
    apply = """changes AS (
  SELECT change, source_path, dest_path, size, kind_changed FROM raw_changes
  WHERE NOT (change = 'add' AND dest_path IN (SELECT new_path FROM rpairs))
    AND NOT (change = 'delete' AND dest_path IN (SELECT old_path FROM rpairs))
  UNION ALL
  SELECT 'rename', old_path, new_path, size, false FROM rpairs)"""
    if renames == "fast":
        rename_part = _fast_walk("raw_changes") + ",\n" + apply
    elif renames:
        rename_part = exact + "\n" + apply
    else:
        rename_part = """changes AS (SELECT change, source_path, dest_path, size, kind_changed FROM raw_changes)"""
    return f"""leftover AS (
  SELECT dest_path AS path, d_is_dir AS is_dir, d_size AS size, d_hash AS content_hash, d_mtime AS mtime
  FROM judged WHERE source_path IS NULL),
lo_ign AS (SELECT *, ({ignored_pred}) AS ign FROM leftover),
deletions AS (
  SELECT l.path, l.is_dir, l.size, l.content_hash, l.mtime FROM lo_ign l
  WHERE NOT l.ign AND NOT EXISTS (SELECT 1 FROM lo_ign x WHERE x.ign AND starts_with(x.path, l.path || '/'))),
raw_changes AS (
  SELECT CASE WHEN d_is_dir IS NULL THEN 'add' ELSE 'modify' END AS change, source_path, dest_path, s_size AS size,
         CASE WHEN d_is_dir IS NULL THEN false ELSE s_is_dir <> d_is_dir END AS kind_changed,
         s_is_dir AS is_dir, s_hash AS content_hash, s_mtime AS mtime
  FROM judged WHERE source_path IS NOT NULL AND NOT equal
  UNION ALL
  SELECT 'delete', NULL, path, size, false, is_dir, content_hash, mtime FROM deletions),
{rename_part}"""


FIXTURE_IGNORED = "path LIKE '/lake/src1/%'"
NOTHING_IGNORED = "false"
JSON_IGNORED = "path LIKE '%.json' OR path LIKE '%.json/%'"


EV_FILES = """ev_files AS (
  SELECT '/' || CAST(user_id AS VARCHAR) || '/' || event_type || '/' || CAST(event_id AS VARCHAR) AS path,
         false AS is_dir, CAST(round(value * 100) AS BIGINT) AS size, CAST(ts AS TIMESTAMP) AS mtime,
         sha256(COALESCE(props, '')) AS content_hash, event_id
  FROM events)"""
EV_DST_FILES = """ev_dst_files AS (
  SELECT CASE WHEN event_id % 10 = 4 THEN regexp_replace(path, '/([0-9]+)$', '/r\\1')
              WHEN event_id % 10 = 6 THEN regexp_replace(path, '/([0-9]+)$', '/x\\1') ELSE path END AS path,
         false AS is_dir,
         CASE WHEN event_id % 10 = 5 THEN size + 1 WHEN event_id % 10 = 6 THEN size + 7 ELSE size END AS size,
         make_timestamp(CAST(epoch_us(mtime) + (event_id % 4) * 700000 AS BIGINT)) AS mtime, content_hash, event_id
  FROM ev_files WHERE event_id % 10 <> 3)"""
# events: in / add /** (read and write paths coincide), fast mode
EV_EXPECTED = """ev_src AS (
  SELECT path, is_dir, size, mtime, content_hash FROM ev_files
  UNION ALL SELECT path, true, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR)
  FROM ev_src_dirs WHERE path NOT IN (SELECT path FROM ev_files)),
ev_dst AS (
  SELECT path, is_dir, size, mtime, content_hash FROM ev_dst_files
  UNION ALL SELECT path, true, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR)
  FROM ev_dst_dirs WHERE path NOT IN (SELECT path FROM ev_dst_files)),
expected AS (SELECT path AS read_path, path AS write_path, is_dir, size, mtime, content_hash FROM ev_src)"""
EV_BASE = [EV_FILES, EV_DST_FILES]


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _fixture_changes() -> str:
    return _with(*BASE, M5, CLAIMS_FIXTURE, EXPECTED, _judged(), _changes(FIXTURE_IGNORED))


def _plain(renames: bool = True) -> str:
    return _with(*BASE, CLAIMS_PLAIN, EXPECTED, _judged(), _changes(NOTHING_IGNORED, renames))


TOTALS = """SELECT t.change, COALESCE(c.n, 0) AS n, (SELECT count(*) FROM changes) = 0 AS up_to_date
FROM (VALUES ('delete'), ('add'), ('modify'), ('rename')) t(change)
LEFT JOIN (SELECT change, count(*) AS n FROM changes GROUP BY change) c USING (change)
UNION ALL
SELECT 'total', count(*), count(*) = 0 FROM changes"""

# the tree rule table: in /backup, add /lake/src1*/en/**
TREE = """claims_t AS (
  SELECT path FROM src_inv WHERE split_part(path, '/', 2) = 'lake' AND split_part(path, '/', 3) LIKE 'src1%'
    AND split_part(path, '/', 4) = 'en' AND len(string_split(path, '/')) >= 5),
tracked_t AS (
  SELECT path FROM claims_t
  UNION
  SELECT DISTINCT array_to_string(list_slice(parts, 1, k), '/') FROM (
    SELECT parts, unnest(generate_series(3, len(parts) - 1)) AS k
    FROM (SELECT string_split(path, '/') AS parts FROM claims_t))),
has_tracked AS (
  SELECT DISTINCT array_to_string(list_slice(parts, 1, k), '/') AS path FROM (
    SELECT parts, unnest(generate_series(2, len(parts) - 1)) AS k
    FROM (SELECT string_split(path, '/') AS parts FROM tracked_t))),
nonempty AS (SELECT DISTINCT """ + _parent("path") + """ AS path FROM src_inv WHERE path LIKE '/lake/%/%'),
tops AS (
  SELECT path FROM nonempty n
  WHERE path NOT IN (SELECT path FROM has_tracked)
    AND (""" + _parent("path") + """ = '/lake' OR """ + _parent("path") + """ IN (SELECT path FROM has_tracked)))"""

PAGES = """pp AS (
  SELECT split_part(url, '://', 1) || '://' || regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS root,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS raw_path
  FROM pages),
segs AS (SELECT root, list_filter(string_split(raw_path, '/'), lambda x: x <> '') AS parts FROM pp),
n_per AS (SELECT root, count(*) AS n, min(parts) AS lo, max(parts) AS hi FROM segs GROUP BY root),
cand AS (SELECT root, k, list_slice(parts, 1, k) AS pre FROM (
  SELECT root, parts, unnest(generate_series(1, len(parts))) AS k FROM segs)),
cover AS (
  SELECT c.root, max(c.k) AS k FROM (SELECT root, k, pre, count(*) AS cnt FROM cand GROUP BY root, k, pre) c
  JOIN n_per USING (root) WHERE c.cnt = n_per.n GROUP BY c.root)"""


def _plain_version() -> str:
    """Version tag of the plain rule table (a hash of its rows)."""
    from sylva.plans.catalog import PLAIN_RULES
    from sylva.plans.rules import compile_rules

    return compile_rules(PLAIN_RULES).version


def _top(limit: int) -> str:
    return f"""SELECT change, CAST(rk AS BIGINT) AS rank, source_path, dest_path,
  CAST(GREATEST(cnt - {limit}, 0) AS BIGINT) AS n_more
FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY {fold('dest_path')}, dest_path) AS rk,
             count(*) OVER (PARTITION BY change) AS cnt FROM changes)
WHERE rk <= {limit}"""


def _applied(actual: str, changes: str) -> str:
    """The destination after a change set."""
    return f"""gone AS (
  SELECT CASE WHEN change = 'rename' THEN source_path ELSE dest_path END AS path FROM {changes} c
  WHERE change IN ('delete', 'rename', 'modify')),
applied AS (
SELECT path, is_dir, size, mtime, content_hash FROM {actual} WHERE path NOT IN (SELECT path FROM gone)
UNION ALL
SELECT e.write_path, e.is_dir, CASE WHEN e.is_dir THEN 0 ELSE e.size END, e.mtime, e.content_hash
FROM {changes} c JOIN expected e ON e.write_path = c.dest_path WHERE c.change IN ('add', 'modify')
UNION ALL
SELECT c.dest_path, d.is_dir, d.size, d.mtime, d.content_hash
FROM {changes} c JOIN {actual} d ON d.path = c.source_path WHERE c.change = 'rename')
"""


def _second_check(changes: str) -> str:
    """Totals of a whole second diff, of the expected rows against the destination after ``changes``."""
    again = _judged(actual="applied WHERE path LIKE '/backup/%'") + ",\n" + _changes(FIXTURE_IGNORED)
    for name in ("actual", "pairs", "judged", "leftover", "lo_ign", "deletions", "raw_changes", "ra", "rd", "rpairs", "changes"):
        again = re.sub(rf"\b{name}\b", f"{name}_2", again)
    return _fixture_changes() + ", " + _applied("dst_inv", changes) + ",\n" + again + "\n" + TOTALS.replace("changes", "changes_2")


def _crowded(side: str) -> str:
    src = side == "src"
    return f"""SELECT '/backup/' || CASE WHEN doc_id % 2 = 0 THEN 'chain' ELSE 'burst' END || '{"/n" if src else "/o"}' || CAST(doc_id AS VARCHAR) AS dest_path,
    '{"add" if src else "delete"}' AS change, false AS is_dir, CAST(CASE WHEN doc_id % 2 = 0 THEN 7 ELSE 8 END AS BIGINT) AS size,
    make_timestamp(CAST(1704067200000000 + CASE WHEN doc_id % 2 = 0 THEN doc_id * 750000 {"" if src else "+ doc_id % 5 * 500000"}
                        ELSE doc_id * {7919 if src else 104729} % 1900 * 1000 END AS BIGINT)) AS mtime
  FROM documents WHERE doc_id % {13 if src else 11} <> 0"""


def queries() -> dict[str, str]:
    fx = _fixture_changes()
    return {
        "inventory_src": _with(*BASE) + "SELECT * FROM src_inv",
        "inventory_dst": _with(*BASE) + "SELECT * FROM dst_inv",
        "normalize_paths": """SELECT doc_id, '/data/lake/' || source || '/' || lang || '/doc' || CAST(doc_id AS VARCHAR) AS path,
  '/data/lake/' || source || '/' || lang AS parent, 'doc' || CAST(doc_id AS VARCHAR) AS name,
  CAST(5 AS BIGINT) AS depth FROM documents""",
        "resolve_roots": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '/lake/' || source || '/doc' || CAST(doc_id AS VARCHAR)
  WHEN doc_id % 3 = 0 THEN '/backup' ELSE '/abs/' || source END AS path FROM documents""",
        "expand_parents": _with(SRC_FILES, _dirs("src_dirs", "src_files")) + "SELECT path, true AS is_dir FROM src_dirs",
        "rebase": _with(SRC_FILES) + "SELECT path, '/backup/' || substr(path, 7) AS rebased FROM src_files",
        "glob_filter": _with(*BASE) + """SELECT path FROM src_inv
WHERE len(string_split(path, '/')) = 5 AND split_part(path, '/', 2) = 'lake'
  AND split_part(path, '/', 3) LIKE 'src1_' AND NOT starts_with(split_part(path, '/', 4), '.')
  AND split_part(path, '/', 5) LIKE '%.json' AND NOT starts_with(split_part(path, '/', 5), '.')""",
        "globstar_filter": _with(*BASE) + f"""SELECT path FROM src_inv
WHERE path LIKE '/lake/%' AND {_name('path')} LIKE 'doc%'
  AND ({_name('path')} LIKE '%0.txt' OR {_name('path')} LIKE '%5.txt')""",
        "subtree_filter": _with(*BASE) + "SELECT path, is_dir FROM src_inv WHERE path = '/lake/src3' OR path LIKE '/lake/src3/%'",
        "ignore_filter": _with(*BASE) + "SELECT path, is_dir FROM src_inv WHERE NOT (path LIKE '%.tmp' OR path LIKE '%.tmp/%')",
        "ignore_filter_end": _with(*BASE) + "SELECT path, is_dir FROM src_inv WHERE NOT path LIKE '/lake/src1/%'",
        "track": _with(*BASE, M5, CLAIMS_FIXTURE, EXPECTED)
        + "SELECT rule_seq, read_path, write_path, rel_path, is_parent, is_dir FROM expected",
        "track_many_rules": _with(*BASE) + f""", c AS (
  SELECT path, {_name('path')} LIKE '%.md' AS md, split_part(path, '/', 4) = 'en' AND len(string_split(path, '/')) > 4 AS en,
         CAST(substr(split_part(path, '/', 3), 4) AS INT) AS k, split_part(path, '/', 3) AS src
  FROM src_inv WHERE split_part(path, '/', 2) = 'lake' AND split_part(path, '/', 3) LIKE 'src%' AND len(string_split(path, '/')) > 3)
SELECT CAST(3 + 2 * k + CASE WHEN md THEN 0 ELSE 1 END AS INT) AS rule_seq, path AS read_path,
  '/backup/' || CASE WHEN md THEN substr(path, 8 + length(src)) ELSE substr(path, 11 + length(src)) END AS write_path
FROM c WHERE (md OR (en AND len(string_split(path, '/')) > 4)) AND NOT (src = 'src3' AND path LIKE '%.log')""",
        "snapshot_diff": _plain(renames=False) + "SELECT * FROM changes",
        "snapshot_diff_orders": """WITH a AS (
  SELECT CASE WHEN o_orderkey % 10 = 6 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey,
         o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 10 = 5 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, CASE WHEN o_orderkey % 10 = 7 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 10 <> 3)
SELECT CASE WHEN a.o_orderkey IS NULL THEN 'add' WHEN e.o_orderkey IS NULL THEN 'delete' ELSE 'modify' END AS change,
       COALESCE(e.o_orderkey, a.o_orderkey) AS o_orderkey
FROM orders e FULL OUTER JOIN a ON e.o_orderkey = a.o_orderkey
WHERE a.o_orderkey IS NULL OR e.o_orderkey IS NULL
   OR e.o_custkey IS DISTINCT FROM a.o_custkey OR e.o_orderstatus IS DISTINCT FROM a.o_orderstatus
   OR e.o_totalprice IS DISTINCT FROM a.o_totalprice OR e.o_orderdate IS DISTINCT FROM a.o_orderdate
   OR e.o_orderpriority IS DISTINCT FROM a.o_orderpriority""",
        "content_equal": _plain() + "SELECT dest_path, equal FROM judged WHERE source_path IS NOT NULL AND d_is_dir IS NOT NULL",
        "content_equal_chunks": """WITH f AS (
  SELECT '/backup/' || source || '/doc' || CAST(doc_id AS VARCHAR) AS dest_path, doc_id % 10 AS k, text,
    CASE doc_id % 10 WHEN 5 THEN text || '!' WHEN 7 THEN reverse(text) ELSE text END AS other
  FROM documents WHERE text IS NOT NULL)
SELECT dest_path, k <> 3 AND text = other AS equal,
  CAST(CASE WHEN k <> 3 AND strlen(text) = strlen(other) THEN 2 * strlen(text) ELSE 0 END AS BIGINT) AS n_read FROM f""",
        "scan_inventory": _with(SRC_FILES, _dirs("src_dirs", "src_files")) + """SELECT path, is_dir,
  CASE WHEN doc_id % 7 = 0 THEN size + 1 ELSE size END AS size,
  CASE WHEN doc_id % 7 = 0 THEN mtime + INTERVAL 1 SECOND ELSE mtime END AS mtime, content_hash FROM src_files
UNION ALL SELECT path, true, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR) FROM src_dirs""",
        "fast_equal": _plain() + """SELECT dest_path,
  CASE WHEN s_is_dir OR d_is_dir THEN s_is_dir AND d_is_dir
       ELSE COALESCE(abs(epoch_us(s_mtime) - epoch_us(d_mtime)) < 2000000, false) END AS equal
FROM judged WHERE source_path IS NOT NULL AND d_is_dir IS NOT NULL""",
        "incremental_equal": _plain() + """, state AS (
  SELECT path AS source_path, '/backup/' || substr(path, 7) AS dest_path, mtime AS source_mtime,
         make_timestamp(CAST(epoch_us(mtime) + (doc_id % 4) * 1000000
                             + CASE WHEN doc_id % 3 = 1 THEN 1000000 ELSE 0 END AS BIGINT)) AS dest_mtime,
         doc_id % 2 = 0 AS equal
  FROM src_files WHERE doc_id % 3 <> 0)
SELECT j.dest_path,
  CASE WHEN s.source_path IS NOT NULL AND s.source_mtime = j.s_mtime AND s.dest_mtime = j.d_mtime THEN s.equal ELSE j.equal END AS equal,
  COALESCE(s.source_path IS NOT NULL AND s.source_mtime = j.s_mtime AND s.dest_mtime = j.d_mtime, false) AS state_hit
FROM judged j LEFT JOIN state s ON s.source_path = j.source_path AND s.dest_path = j.dest_path
WHERE j.source_path IS NOT NULL AND j.d_is_dir IS NOT NULL AND NOT j.s_is_dir AND NOT j.d_is_dir""",
        "orphans": _with(*BASE, CLAIMS_ORPHAN, EXPECTED, _judged(), _changes(JSON_IGNORED, renames=False))
        + "SELECT dest_path AS path FROM changes WHERE change = 'delete'",
        "detect_renames": _plain() + "SELECT source_path, dest_path, size FROM changes WHERE change = 'rename'",
        "change_totals": fx + TOTALS,
        "tree_counts": _with(*BASE, TREE) + """SELECT '/lake' AS search_path,
  CAST(count_if(is_dir) AS BIGINT) AS n_dirs, CAST(count_if(NOT is_dir) AS BIGINT) AS n_files,
  CAST(count_if(is_dir AND NOT t) AS BIGINT) AS n_ignored_dirs, CAST(count_if(NOT is_dir AND NOT t) AS BIGINT) AS n_ignored_files
FROM (SELECT is_dir, path IN (SELECT path FROM tracked_t) AS t FROM src_inv WHERE path LIKE '/lake/%')""",
        "common_parent": _with(PAGES) + """SELECT n.root,
  '/' || array_to_string(CASE WHEN n.lo = n.hi THEN list_slice(n.lo, 1, len(n.lo) - 1)
                              ELSE list_slice(n.lo, 1, COALESCE(cv.k, 0)) END, '/') AS common_path
FROM n_per n LEFT JOIN cover cv USING (root)""",
        "pruned_subtrees": _with(*BASE, TREE)
        + "SELECT path, CAST(len(string_split(path, '/')) - 2 AS BIGINT) AS depth FROM tops",
        "duplicate_claims": _with(*BASE, M5, CLAIMS_FIXTURE, EXPECTED) + """, reach AS (
  SELECT 5 AS rule_seq, path FROM m5
  UNION ALL SELECT 8, path FROM src_inv WHERE path LIKE '/lake/%' AND NOT path LIKE '/lake/src1/%'
  UNION ALL SELECT rule_seq, path FROM parents)
SELECT path AS read_path, count(DISTINCT rule_seq) AS n_rules, min(rule_seq) AS first_seq,
       '/backup/' || substr(path, 7) AS write_path
FROM reach GROUP BY path HAVING count(DISTINCT rule_seq) > 1""",
        "case_collisions": _with(SRC_FILES) + f""", allp AS (
  SELECT path FROM src_files
  UNION ALL SELECT replace(path, '/doc', '/Doc') FROM src_files WHERE doc_id % 7 = 0)
SELECT {fold('path')} AS folded, count(DISTINCT path) AS n_paths, min(path) AS first_path, max(path) AS last_path
FROM allp GROUP BY {fold('path')} HAVING count(DISTINCT path) > 1""",
        "top_changes": fx + _top(5),
        "top_changes_wide": fx + _top(1500),
        "tree_listing": _with(*BASE, TREE) + f""", rows AS (
  SELECT path, is_dir, path IN (SELECT path FROM tracked_t) AS tracked, {_parent('path')} AS parent,
         {_name('path')} AS name
  FROM src_inv WHERE path LIKE '/lake/%'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY parent ORDER BY {fold('name')} DESC, name DESC) = 1 AS is_last,
    row_number() OVER (ORDER BY [{{'f': {fold('x')}, 'r': x}} FOR x IN string_split(path, '/')]) - 1 AS pre FROM rows),
below AS (SELECT d.path, count(*) AS n FROM rows d JOIN rows r ON starts_with(r.path, d.path || '/') WHERE d.is_dir GROUP BY d.path)
SELECT path, CAST(len(string_split(path, '/')) - 2 AS BIGINT) AS depth, name, is_dir, tracked, is_last,
  path IN (SELECT path FROM tops) AS pruned,
  CASE WHEN tracked AND (NOT is_dir OR path NOT IN (SELECT parent FROM rows)) THEN '/backup/' || substr(path, 7) END AS dest,
  pre, COALESCE(below.n, 0) AS n_below
FROM ranked r LEFT JOIN below USING (path) WHERE NOT EXISTS (SELECT 1 FROM tops t WHERE starts_with(r.path, t.path || '/'))""",
        "operation_plan": fx + """SELECT CASE change WHEN 'add' THEN 1 WHEN 'rename' THEN 2 WHEN 'delete' THEN 3 ELSE 4 END AS phase,
  change, source_path, dest_path FROM changes""",
        "apply_changes": fx + ", " + _applied("dst_inv", "changes") + "SELECT * FROM applied",
        "verify_converged": _second_check("changes"),
        "verify_interrupted": _second_check("(SELECT * FROM changes WHERE change IN ('add', 'rename'))"),
        "sync_report": fx + "SELECT * FROM changes",
        "sync_report_fast": _with(*BASE, M5, CLAIMS_FIXTURE, EXPECTED, _judged(FAST_EQ),
                                  _changes(FIXTURE_IGNORED, "fast")) + "SELECT * FROM changes",
        "detect_renames_fast": _with(*EV_BASE, _dirs("ev_src_dirs", "ev_files"), _dirs("ev_dst_dirs", "ev_dst_files"),
                                     EV_EXPECTED, _judged(FAST_EQ, "ev_dst"), _changes(NOTHING_IGNORED, "fast"))
        + "SELECT source_path, dest_path, size FROM changes WHERE change = 'rename'",
        "detect_renames_crowded": f"WITH crowd AS ({_crowded('src')}\n  UNION ALL {_crowded('dst')}),\n" + _fast_walk("crowd")
        + "SELECT old_path AS source_path, new_path AS dest_path, size FROM rpairs",
        "write_changes": fx + "SELECT * FROM changes",
        "state_roundtrip": _plain() + f"""SELECT source_path, dest_path, s_mtime AS source_mtime, d_mtime AS dest_mtime,
  equal, '{_plain_version()}' AS rules_version
FROM judged WHERE source_path IS NOT NULL AND d_is_dir IS NOT NULL AND NOT s_is_dir AND NOT d_is_dir""",
        "keyed_totals_orders": """WITH a AS (
  SELECT CASE WHEN o_orderkey % 10 = 6 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey,
         o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 10 = 5 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, CASE WHEN o_orderkey % 10 = 7 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 10 <> 3),
changes AS (
  SELECT CASE WHEN a.o_orderkey IS NULL THEN 'add' WHEN e.o_orderkey IS NULL THEN 'delete' ELSE 'modify' END AS change
  FROM orders e FULL OUTER JOIN a ON e.o_orderkey = a.o_orderkey
  WHERE a.o_orderkey IS NULL OR e.o_orderkey IS NULL
     OR e.o_custkey IS DISTINCT FROM a.o_custkey OR e.o_orderstatus IS DISTINCT FROM a.o_orderstatus
     OR e.o_totalprice IS DISTINCT FROM a.o_totalprice OR e.o_orderdate IS DISTINCT FROM a.o_orderdate
     OR e.o_orderpriority IS DISTINCT FROM a.o_orderpriority)
""" + TOTALS,
    }
