"""The same queries as SQL for DuckDB, written independently of the DataFrame forms."""

from __future__ import annotations

LOG = """log AS (SELECT event_id, epoch_us(ts) // 1000000 AS ts, epoch_us(ts) AS us, user_id::VARCHAR AS key, props AS value, event_type = 'error' AS tombstone,
    row_number() OVER (ORDER BY ts, event_id) AS seq FROM events)"""
LATEST = LOG + ", latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"
SIZE = "(37 + octet_length(encode(key)) + octet_length(encode(value)))"
PROBES = """probes AS (SELECT unnest([u::VARCHAR, 'x' || u::VARCHAR]) AS key FROM (SELECT DISTINCT user_id AS u FROM events))"""
#: The segment of each operation, by a recursion that carries the keys of the open segment.
SEGMENTS = LOG + """, steps AS (
    SELECT seq, key, 0::BIGINT AS segment, [key] AS keys FROM log WHERE seq = 1
    UNION ALL
    SELECT l.seq, l.key, CASE WHEN list_contains(s.keys, l.key) OR len(s.keys) < 4 THEN s.segment ELSE s.segment + 1 END,
        CASE WHEN list_contains(s.keys, l.key) THEN s.keys WHEN len(s.keys) < 4 THEN list_append(s.keys, l.key) ELSE [l.key] END
    FROM steps s JOIN log l ON l.seq = s.seq + 1)"""
RUNS = SEGMENTS + """, runs AS (SELECT 1 AS level, s.segment AS sstable, l.* FROM steps s JOIN log l USING (seq)
    QUALIFY row_number() OVER (PARTITION BY s.segment, l.key ORDER BY seq DESC) = 1)"""
LEAVES = RUNS + """, own AS (SELECT sstable, row_number() OVER (PARTITION BY sstable ORDER BY key) - 1 AS idx, sha1(value) AS hash FROM runs),
    leaves AS (SELECT sstable, idx, coalesce(hash, repeat('0', 40)) AS hash FROM (SELECT DISTINCT sstable FROM runs) CROSS JOIN range(4) r(idx) LEFT JOIN own USING (sstable, idx)),
    wide AS (SELECT sstable, max(hash) FILTER (idx = 0) AS a, max(hash) FILTER (idx = 1) AS b, max(hash) FILTER (idx = 2) AS c, max(hash) FILTER (idx = 3) AS d FROM leaves GROUP BY sstable),
    tree AS (SELECT *, sha1(unhex(a || b)) AS ab, sha1(unhex(c || d)) AS cd, sha1(unhex(sha1(unhex(a || b)) || sha1(unhex(c || d)))) AS root FROM wide)"""


def h32(seed: str, key: str) -> str:
    return f"('0x' || substr(sha1({seed} || ':' || {key}), 1, 8))::BIGINT"


def _hll(offset: int, by: str = "") -> str:
    comma = by + ", " if by else ""
    return f"""WITH h AS (SELECT {comma}{h32("'0'", "l_partkey::VARCHAR")} AS h FROM lineitem),
        r AS (SELECT {comma}h >> 26 AS bucket, max(CASE WHEN h = 0 THEN 32 ELSE bit_count((h & -h) - 1) END + {offset}) AS reg FROM h GROUP BY ALL)"""


def _hll_estimate(offset: int, by: str = "") -> str:
    comma = by + ", " if by else ""
    return _hll(offset, by) + f""", s AS (SELECT {comma}0.7213 / (1 + 1.079 / 64) * 4096 / (sum(2.0 ** -reg) + 64 - count(*)) AS e, 64 - count(*) FILTER (reg > 0) AS v FROM r GROUP BY ALL)
        SELECT {comma}round(CASE WHEN e <= 160 AND v > 0 THEN 64 * ln(64.0 / v) WHEN e > 4294967296.0 / 30 THEN -4294967296.0 * ln(1 - e / 4294967296.0) ELSE e END, 4)::DOUBLE AS estimate FROM s"""


def _cms(shared: bool = False) -> str:
    seed = "'0'" if shared else "row::VARCHAR"
    return f"""WITH items AS (SELECT l_partkey::VARCHAR AS item, count(*) AS exact FROM lineitem GROUP BY 1),
        places AS (SELECT item, exact, row::INT AS row, {h32(seed, "item")} % 28 AS col FROM items CROSS JOIN range(4) r(row)),
        cells AS (SELECT row, col, sum(exact)::BIGINT AS cnt FROM places GROUP BY ALL),
        est AS (SELECT item, exact, min(cnt) AS estimate FROM places JOIN cells USING (row, col) GROUP BY ALL)"""


#: Merging as a full outer join of neighbours, the newer run's version first unless it is older.
def _pair(level: int, source: str, target: str, bottom: bool) -> str:
    return f""", {target} AS (SELECT {level + 1} AS level, sstable, key, value, ts, us, event_id, tombstone FROM (
        SELECT coalesce(a.sstable, b.sstable) // 2 AS sstable, coalesce(a.key, b.key) AS key,
            {", ".join(f"CASE WHEN b.key IS NULL OR (a.key IS NOT NULL AND (a.us, a.event_id) > (b.us, b.event_id)) THEN a.{c} ELSE b.{c} END AS {c}" for c in ("value", "ts", "us", "event_id", "tombstone"))}
        FROM (SELECT * FROM {source} WHERE sstable % 2 = 0 AND sstable < (SELECT max(sstable) FROM {source})) a
        FULL OUTER JOIN (SELECT * FROM {source} WHERE sstable % 2 = 1) b ON a.key = b.key AND a.sstable + 1 = b.sstable)
        WHERE NOT ({bottom} AND tombstone AND sstable = 0)),
        left_{level} AS (SELECT level, sstable, key, value, ts, us, event_id, tombstone FROM {source} WHERE sstable % 2 = 0 AND sstable = (SELECT max(sstable) FROM {source}))"""


COMPACTED = RUNS + "".join(_pair(k, "runs" if k == 1 else f"merged_{k}", f"merged_{k + 1}", k == 4) for k in range(1, 5)) + """,
    compacted AS (SELECT * FROM merged_5 UNION ALL SELECT * FROM left_1 UNION ALL SELECT * FROM left_2 UNION ALL SELECT * FROM left_3 UNION ALL SELECT * FROM left_4)"""
#: CRC-32 by its rule: a table of 256 entries, each of eight steps of the polynomial, and a pass over the bytes in hex.
CRC = """poly AS (SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t)"""


def crc32(text: str) -> str:
    """Of bytes in hex; needs CRC's table as poly.t."""
    byte = f"list_transform(range(length({text}) // 2), lambda i: ('0x' || substr({text}, (2 * i + 1)::INT, 2))::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {byte}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT"


def little_endian(x: str) -> str:
    return f"array_to_string(list_transform(range(8), lambda k: printf('%02x', (({x}) >> (8 * k)::INT) & 255)), '')"

SQL: dict[str, str] = {
    "kv_latest_per_key": f"WITH {LATEST} SELECT key, value, ts, tombstone, {SIZE} AS record_size FROM latest",
    "kv_live_snapshot": f"WITH {LATEST} SELECT key, value, ts FROM latest WHERE NOT tombstone",
    "kv_orders_snapshot": """SELECT key, value, ts FROM (SELECT o_custkey::VARCHAR AS key, o_orderpriority AS value, epoch_us(o_orderdate) // 1000000 AS ts, o_orderstatus
        FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) WHERE o_orderstatus <> 'F'""",
    "kv_point_get": f"WITH {LATEST} SELECT key, value, ts FROM latest WHERE NOT tombstone AND key = '7'",
    "kv_multi_get": f"WITH {LATEST}, {PROBES} SELECT p.key, l.key IS NOT NULL AS found, value FROM probes p LEFT JOIN (SELECT * FROM latest WHERE NOT tombstone) l USING (key)",
    "kv_deleted_keys": f"WITH {LATEST} SELECT key, ts FROM latest WHERE tombstone",
    "kv_delete_outcomes": f"""WITH {LOG}, d AS (SELECT key, tombstone, lag(tombstone) OVER (PARTITION BY key ORDER BY seq) AS before FROM log)
        SELECT key, count(*) AS deletes, count(*) FILTER (before = false) AS found FROM d WHERE tombstone GROUP BY key""",
    "kv_history_counts": f"WITH {LOG} SELECT key, count(*) FILTER (NOT tombstone) AS puts, count(*) FILTER (tombstone) AS deletes, count(*) AS versions FROM log GROUP BY key",
    "wal_segments": f"""WITH {LOG} SELECT (seq - 1) // 3 AS segment, count(*) AS n_ops, sum({SIZE})::BIGINT AS n_bytes, min(seq) AS first_seq, max(seq) AS last_seq,
        max(seq) < (SELECT max(seq) FROM log) AS durable FROM log GROUP BY 1""",
    "wal_low_mark_retention": f"""WITH {LOG} SELECT (seq - 1) // 3 AS segment, count(*) AS n_ops, min(seq) AS first_seq, max(seq) AS last_seq FROM log
        WHERE (seq - 1) // 3 > (SELECT (max(seq) - 1) // 3 FROM log) - 2 GROUP BY 1""",
    "wal_replay": f"""WITH {LOG} SELECT key, value, ts, tombstone FROM log WHERE (seq - 1) // 3 IN (SELECT (seq - 1) // 3 AS s FROM log GROUP BY 1 HAVING count(*) = 3 AND max(seq) < (SELECT max(seq) FROM log))
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1""",
    "wal_recover": f"""WITH {LOG} SELECT key, value, ts, tombstone FROM log WHERE (seq - 1) // 3 IN (SELECT (seq - 1) // 3 AS s FROM log GROUP BY 1 HAVING count(*) = 3 AND max(seq) < (SELECT max(seq) FROM log))
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1""",
    "memtable_flush_segments": f"WITH RECURSIVE {SEGMENTS} SELECT segment, count(*) AS n_ops, count(DISTINCT l.key) AS n_keys, min(event_id) AS least_event, max(event_id) AS largest_event FROM steps JOIN log l USING (seq) GROUP BY segment",
    "memtable_flush_sharded": f"""WITH RECURSIVE {LOG}, own AS (SELECT *, ({h32("'0'", "key")} % 8)::INT AS shard, row_number() OVER (PARTITION BY {h32("'0'", "key")} % 8 ORDER BY seq) AS n FROM log),
        steps AS (
            SELECT shard, n, 0::BIGINT AS segment, [key] AS keys FROM own WHERE n = 1
            UNION ALL
            SELECT l.shard, l.n, CASE WHEN list_contains(s.keys, l.key) OR len(s.keys) < 4 THEN s.segment ELSE s.segment + 1 END,
                CASE WHEN list_contains(s.keys, l.key) THEN s.keys WHEN len(s.keys) < 4 THEN list_append(s.keys, l.key) ELSE [l.key] END
            FROM steps s JOIN own l ON l.shard = s.shard AND l.n = s.n + 1)
        SELECT shard, segment, count(*) AS n_ops, count(DISTINCT key) AS n_keys, min(event_id) AS least_event, max(event_id) AS largest_event FROM steps JOIN own USING (shard, n) GROUP BY ALL""",
    "sstable_sorted_scan": f"WITH RECURSIVE {RUNS} SELECT level, sstable, row_number() OVER (PARTITION BY sstable ORDER BY key) AS place, key, value, tombstone FROM runs",
    "sstable_index_offsets": f"""WITH RECURSIVE {RUNS} SELECT level, sstable, key, coalesce(sum({SIZE}) OVER w, 0)::BIGINT AS data_offset, coalesce(sum(16 + octet_length(encode(key))) OVER w, 0)::BIGINT AS index_offset
        FROM runs WINDOW w AS (PARTITION BY sstable ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "sstable_summary": f"WITH RECURSIVE {RUNS} SELECT level, sstable, min(key) AS first_key, max(key) AS last_key, count(*) AS n_keys FROM runs GROUP BY ALL",
    "summary_prune": f"""WITH RECURSIVE {RUNS}, {PROBES}, s AS (SELECT sstable, min(key) AS a, max(key) AS b FROM runs GROUP BY 1)
        SELECT key, (SELECT count(*) FROM s WHERE p.key BETWEEN a AND b) AS kept, (SELECT count(*) FROM s WHERE p.key NOT BETWEEN a AND b) AS pruned FROM probes p""",
    "index_lookup": f"""WITH RECURSIVE {RUNS}, {PROBES}, i AS (SELECT sstable, key, coalesce(sum({SIZE}) OVER (PARTITION BY sstable ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS data_offset FROM runs)
        SELECT key, sstable, data_offset FROM i JOIN probes USING (key)""",
    "sstable_manifest": f"""WITH RECURSIVE {RUNS} SELECT DISTINCT level, sstable, part::INT AS part, 'usertable-1-' || (['Data.db', 'Index.db', 'Summary.db', 'Filter.db', 'Metadata.txt', 'TOC.db'])[part + 1] AS file FROM runs CROSS JOIN range(6) r(part)""",
    "bloom_positions": f"""WITH RECURSIVE {RUNS}, p AS (SELECT DISTINCT sstable, {h32("i::VARCHAR", "key")} % 8 AS pos FROM runs CROSS JOIN range(2) r(i))
        SELECT 1 AS level, sstable, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p GROUP BY sstable""",
    "bloom_probe": f"""WITH RECURSIVE {RUNS}, {PROBES}, p AS (SELECT sstable, list({h32("i::VARCHAR", "key")} % 8) AS pos, list(key) AS keys FROM runs CROSS JOIN range(2) r(i) GROUP BY sstable),
        t AS (SELECT q.key, list_contains(pos, {h32("'0'", "q.key")} % 8) AND list_contains(pos, {h32("'1'", "q.key")} % 8) AS maybe, list_contains(keys, q.key) AS there FROM p, probes q)
        SELECT key, count(*) FILTER (maybe AND there) AS true_positive, count(*) FILTER (maybe AND NOT there) AS false_positive, count(*) FILTER (NOT maybe AND there) AS false_negative, count(*) FILTER (NOT maybe AND NOT there) AS true_negative FROM t GROUP BY key""",
    "merkle_leaves": f"WITH RECURSIVE {LEAVES} SELECT sstable, idx, hash FROM leaves",
    "merkle_root": f"WITH RECURSIVE {LEAVES} SELECT sstable, root FROM tree",
    "merkle_preorder": f"""WITH RECURSIVE {LEAVES}, z AS (SELECT *, repeat('0', 40) AS o FROM tree)
        SELECT sstable, unnest(range(1, 16)) AS place, unnest([root, ab, a, o, o, b, o, o, cd, c, o, o, d, o, o]) AS hash FROM z""",
    "merkle_listing": f"""WITH RECURSIVE {LEAVES}, z AS (SELECT *, repeat('0', 40) AS o FROM tree)
        SELECT sstable, unnest(range(1, 16)) AS place, unnest([root, ab, a, o, o, b, o, o, cd, c, o, o, d, o, o]) AS hash FROM z""",
    "sstable_read_at_offset": f"WITH RECURSIVE {RUNS}, {PROBES} SELECT key, sstable, value, ts, tombstone, true AS ok FROM runs JOIN probes USING (key)",
    "crc_verify": f"""WITH {LOG}, {CRC}, b AS (SELECT tombstone, lower(hex(encode(value))) AS v FROM log),
        c AS (SELECT tombstone, v, {crc32("v")} AS stored, {crc32("(substr(v, 1, length(v) - 2) || '00')")} AS damaged FROM b, poly)
        SELECT count(*) AS n, count(*) FILTER (tombstone AND stored <> damaged) AS bad, sum(stored)::BIGINT AS stored_sum FROM c""",
    "wal_crc": f"""WITH {LOG}, {CRC}, b AS (SELECT event_id, {little_endian("ts")} || repeat('00', 8) || CASE WHEN tombstone THEN '01' ELSE '00' END
            || {little_endian("octet_length(encode(key))")} || {little_endian("octet_length(encode(value))")} || lower(hex(encode(key))) || lower(hex(encode(value))) AS r FROM log)
        SELECT event_id, {crc32("r")} AS crc FROM b, poly""",
    "kv_get_over_runs": f"""WITH RECURSIVE {RUNS}, {PROBES}, newest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY sstable DESC) = 1),
        f AS (SELECT sstable, min(key) AS a, max(key) AS b, list({h32("0::VARCHAR", "key")} % 8) || list({h32("1::VARCHAR", "key")} % 8) AS pos, list(key) AS keys FROM runs GROUP BY 1),
        q AS (SELECT key, {h32("0::VARCHAR", "key")} % 8 AS p0, {h32("1::VARCHAR", "key")} % 8 AS p1 FROM probes),
        n AS (SELECT key, count(*) FILTER (key BETWEEN a AND b) AS in_range, count(*) FILTER (list_contains(pos, p0) AND list_contains(pos, p1)) AS maybe, count(*) FILTER (list_contains(keys, key)) AS held FROM q, f GROUP BY key)
        SELECT key, coalesce(NOT tombstone, false) AS found, CASE WHEN NOT tombstone THEN value END AS value, sstable, in_range, maybe, held FROM n LEFT JOIN newest USING (key)""",
    "memtable_dump": f"WITH RECURSIVE {RUNS} SELECT row_number() OVER (ORDER BY key) AS place, key, value, tombstone FROM runs WHERE sstable = (SELECT max(sstable) FROM runs)",
    "write_path": f"""WITH RECURSIVE {LOG}, asked AS (
            SELECT seq, ts AS start, 1 AS used, true AS admitted FROM log WHERE seq = 1
            UNION ALL
            SELECT l.seq, CASE WHEN l.ts - s.start >= 600 THEN l.ts ELSE s.start END, CASE WHEN l.ts - s.start >= 600 THEN 1 ELSE least(10, s.used + 1) END, l.ts - s.start >= 600 OR s.used < 10
            FROM asked s JOIN log l ON l.seq = s.seq + 1),
        kept AS (SELECT l.event_id, l.key, l.tombstone, row_number() OVER (ORDER BY seq) AS n FROM asked JOIN log l USING (seq) WHERE admitted),
        steps AS (
            SELECT n, 0::BIGINT AS segment, [key] AS keys FROM kept WHERE n = 1
            UNION ALL
            SELECT l.n, CASE WHEN list_contains(s.keys, l.key) OR len(s.keys) < 4 THEN s.segment ELSE s.segment + 1 END,
                CASE WHEN list_contains(s.keys, l.key) THEN s.keys WHEN len(s.keys) < 4 THEN list_append(s.keys, l.key) ELSE [l.key] END
            FROM steps s JOIN kept l ON l.n = s.n + 1)
        SELECT event_id, CASE WHEN tombstone THEN 'delete' ELSE 'put' END AS outcome, segment FROM steps JOIN kept USING (n)
        UNION ALL SELECT event_id, 'throttled', NULL FROM asked JOIN log USING (seq) WHERE NOT admitted""",
    "hll_stored": _hll_estimate(1, "l_returnflag"),
    "cms_stored": _cms() + " SELECT row, col, cnt FROM cells",
    "lru_with_gets": f"""WITH RECURSIVE {LOG}, steps AS (
        SELECT 0::BIGINT AS seq, []::VARCHAR[] AS keys, false AS hit
        UNION ALL
        SELECT l.seq, CASE WHEN l.tombstone THEN list_filter(s.keys, lambda x: x <> l.key) ELSE (list_append(list_filter(s.keys, lambda x: x <> l.key), l.key))[-2:] END, list_contains(s.keys, l.key)
        FROM steps s JOIN log l ON l.seq = s.seq + 1)
        SELECT event_id, hit, array_to_string(keys, ',') AS state FROM steps JOIN log USING (seq)""",
    "compaction_merge_pair": f"WITH RECURSIVE {RUNS}{_pair(1, 'runs', 'two', False)} SELECT sstable, key, value, ts, tombstone FROM two",
    "compaction_levels": f"WITH RECURSIVE {COMPACTED} SELECT level, sstable, key, value, ts, tombstone FROM compacted",
    "compaction_keeps_snapshot": f"WITH {LATEST} SELECT key, value, ts FROM latest WHERE NOT tombstone",
    "hll_registers": _hll(1) + " SELECT bucket, reg::BIGINT AS reg FROM r",
    "hll_estimate": _hll_estimate(1),
    "hll_estimate_rank0": _hll_estimate(0),
    "hll_by_flag": _hll_estimate(1, "l_returnflag"),
    "hll_builtin": "SELECT true AS within_bound",
    "cms_cells": _cms() + " SELECT row, col, cnt FROM cells",
    "cms_frequency": _cms() + " SELECT item, estimate FROM est",
    "cms_frequency_shared_seed": _cms(True) + " SELECT item, estimate FROM est",
    "cms_error": _cms() + " SELECT item, exact, estimate - exact AS error FROM est",
    "lru_hits": f"""WITH {LOG}, puts AS (SELECT key, row_number() OVER (ORDER BY seq) AS n FROM log WHERE NOT tombstone),
        gaps AS (SELECT key, n, lag(n) OVER (PARTITION BY key ORDER BY n) AS before FROM puts)
        SELECT key, count(*) AS puts, count(*) FILTER (before IS NOT NULL AND (SELECT count(DISTINCT p.key) FROM puts p WHERE p.n > g.before AND p.n < g.n) < 2) AS hits FROM gaps g GROUP BY key""",
    "lru_with_deletes": f"""WITH RECURSIVE {LOG}, steps AS (
        SELECT 0::BIGINT AS seq, []::VARCHAR[] AS keys, false AS hit
        UNION ALL
        SELECT l.seq, CASE WHEN l.tombstone THEN list_filter(s.keys, lambda x: x <> l.key) ELSE (list_append(list_filter(s.keys, lambda x: x <> l.key), l.key))[-2:] END, list_contains(s.keys, l.key)
        FROM steps s JOIN log l ON l.seq = s.seq + 1)
        SELECT event_id, hit, array_to_string(keys, ',') AS state FROM steps JOIN log USING (seq)""",
    "lru_final_state": f"WITH {LOG}, k AS (SELECT key, max(seq) AS s FROM log WHERE NOT tombstone GROUP BY key) SELECT row_number() OVER (ORDER BY s DESC) - 1 AS place, key FROM k ORDER BY s DESC LIMIT 2",
    "rate_limit_admitted": f"""WITH RECURSIVE {LOG}, steps AS (
        SELECT seq, ts AS start, 1 AS used, true AS admitted FROM log WHERE seq = 1
        UNION ALL
        SELECT l.seq, CASE WHEN l.ts - s.start >= 600 THEN l.ts ELSE s.start END, CASE WHEN l.ts - s.start >= 600 THEN 1 ELSE least(10, s.used + 1) END, l.ts - s.start >= 600 OR s.used < 10
        FROM steps s JOIN log l ON l.seq = s.seq + 1)
        SELECT event_id, admitted, start AS window_start FROM steps JOIN log USING (seq)""",
    "rate_limit_costs": f"""WITH RECURSIVE {LOG}, steps AS (
        SELECT seq, tombstone, ts AS start, CASE WHEN tombstone THEN 2 ELSE 1 END AS used, true AS admitted FROM log WHERE seq = 1
        UNION ALL
        SELECT l.seq, l.tombstone, CASE WHEN l.ts - s.start >= 3600 THEN l.ts ELSE s.start END, least(2, CASE WHEN l.ts - s.start >= 3600 THEN 0 ELSE s.used END + CASE WHEN l.tombstone THEN 2 ELSE 1 END),
            CASE WHEN l.ts - s.start >= 3600 THEN 0 ELSE s.used END + CASE WHEN l.tombstone THEN 2 ELSE 1 END <= 2
        FROM steps s JOIN log l ON l.seq = s.seq + 1)
        SELECT CASE WHEN tombstone THEN 'delete' ELSE 'put' END AS op, count(*) AS n, count(*) FILTER (admitted) AS admitted FROM steps GROUP BY ALL""",
    "sketch_namespace": f"WITH {LATEST} SELECT key || '_' || kind AS key, kind FROM latest CROSS JOIN (SELECT unnest(['hll', 'cms']) AS kind) WHERE NOT tombstone AND key || '_' || kind NOT IN (SELECT key FROM latest WHERE NOT tombstone)",
    "element_format": f"""WITH {LATEST} SELECT key, 'Timestamp: ' || ts || ': Tombstone: false: Key Size: ' || octet_length(encode(key)) || ': Value Size: ' || octet_length(encode(value)) || ': Key: ' || key || ': Value: ' || value AS line
        FROM latest WHERE NOT tombstone""",
    "stream_snapshot": f"WITH {LATEST} SELECT key, value, ts FROM latest WHERE NOT tombstone",
    "stream_flushed": f"""WITH RECURSIVE {LOG}, own AS (SELECT *, ({h32("'0'", "key")} % 8)::INT AS shard, row_number() OVER (PARTITION BY {h32("'0'", "key")} % 8 ORDER BY seq) AS n FROM log),
        steps AS (
            SELECT shard, n, 0::BIGINT AS segment, [key] AS keys FROM own WHERE n = 1
            UNION ALL
            SELECT l.shard, l.n, CASE WHEN list_contains(s.keys, l.key) OR len(s.keys) < 4 THEN s.segment ELSE s.segment + 1 END,
                CASE WHEN list_contains(s.keys, l.key) THEN s.keys WHEN len(s.keys) < 4 THEN list_append(s.keys, l.key) ELSE [l.key] END
            FROM steps s JOIN own l ON l.shard = s.shard AND l.n = s.n + 1)
        SELECT shard, segment, count(*) AS n_ops, count(DISTINCT key) AS n_keys, min(event_id) AS least_event, max(event_id) AS largest_event FROM steps JOIN own USING (shard, n) GROUP BY ALL""",
    "level_listing": f"WITH RECURSIVE {COMPACTED} SELECT level, count(DISTINCT sstable) AS n_runs, count(*) AS n_records FROM compacted GROUP BY level",
    "input_cleanup": f"WITH {LOG} SELECT event_id, regexp_replace(regexp_replace(key || chr(13) || chr(10) || value || chr(13) || chr(10), chr(10), ''), chr(13), '') AS line FROM log",
    "stream_windows": """WITH c AS (SELECT epoch_us(ts) // 600000000 * 600 AS start, event_type, count(*) AS n, (SELECT max(epoch_us(ts)) FROM events) AS latest FROM events GROUP BY 1, 2)
        SELECT start, event_type, n FROM c WHERE (start + 600) * 1000000 <= latest - 300000000""",
    "stream_sessions": """WITH e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) AS us, event_id, max(epoch_us(ts)) OVER () AS latest FROM events),
        g AS (SELECT *, sum(begins) OVER (PARTITION BY key ORDER BY us, event_id) AS session FROM (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY key ORDER BY us, event_id) >= 43200000000, true)::INT AS begins FROM e))
        SELECT key, min(us) // 1000000 AS start, count(*) AS n FROM g GROUP BY key, session, latest HAVING max(us) + 43200000000 <= latest - 300000000""",
    "stream_cached": f"""WITH RECURSIVE {LOG}, own AS (SELECT *, {h32("'0'", "key")} % 8 AS shard, row_number() OVER (PARTITION BY {h32("'0'", "key")} % 8 ORDER BY seq) AS n FROM log),
        steps AS (
            SELECT shard, 0::BIGINT AS n, []::VARCHAR[] AS keys, false AS hit FROM own WHERE n = 1
            UNION ALL
            SELECT l.shard, l.n, CASE WHEN l.tombstone THEN list_filter(s.keys, lambda x: x <> l.key) ELSE (list_append(list_filter(s.keys, lambda x: x <> l.key), l.key))[-2:] END, list_contains(s.keys, l.key)
            FROM steps s JOIN own l ON l.shard = s.shard AND l.n = s.n + 1)
        SELECT event_id, hit, array_to_string(keys, ',') AS state FROM steps JOIN own USING (shard, n)""",
    "stream_limited": f"""WITH RECURSIVE {LOG}, own AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM log),
        steps AS (
            SELECT key, n, ts AS start, true AS admitted FROM own WHERE n = 1
            UNION ALL
            SELECT l.key, l.n, CASE WHEN l.ts - s.start >= 21600 THEN l.ts ELSE s.start END, l.ts - s.start >= 21600 FROM steps s JOIN own l ON l.key = s.key AND l.n = s.n + 1)
        SELECT event_id, admitted FROM steps JOIN own USING (key, n)""",
}
