"""The queries' results in SQL that DuckDB can run, from the driver's tables and not from the text lines, and with nothing taken from the operators."""

from __future__ import annotations

from itertools import combinations

MATRIX = ["REDUNDANT_IO", "LOG_GC", "APPROX", "INDUCTION", "UNSUPPORTED", "IBURST", "TAG", "DPRESERVE_FD", "DPRESERVE_SD", "NODEMERGE"]
CDM = """c AS (
  SELECT 'e' || seq AS uuid, 's' || pid AS s, 'o' || inode AS o, seq, sec, pid, inode, split_part(kind, ' ', 1) AS type, split_part(kind, ' ', 2) AS call, syscall IN (0, 2, 3, 43, 45) AS forward FROM (SELECT *,
    CASE syscall WHEN 0 THEN 'EVENT_READ 0' WHEN 1 THEN 'EVENT_WRITE 1' WHEN 2 THEN 'EVENT_OPEN 2' WHEN 3 THEN 'EVENT_CLOSE 3' WHEN 59 THEN 'EVENT_EXECUTE 59' WHEN 45 THEN 'EVENT_RECVFROM 45' WHEN 44 THEN 'EVENT_SENDTO 44'
      WHEN 42 THEN 'EVENT_CONNECT 42' WHEN 43 THEN 'EVENT_ACCEPT 43' WHEN 10 THEN 'EVENT_MPROTECT 10' WHEN 41 THEN 'EVENT_OTHER 11' WHEN 87 THEN 'EVENT_UNLINK 87' WHEN 263 THEN 'EVENT_TRUNCATE 76' ELSE 'EVENT_EXIT 60' END AS kind FROM ev)
)"""
MODIFYING = "('FORKED_BY', 'WAS_GENERATED_BY', 'UNLINKED_BY')"
ROUNDS = 8  # of garbage collection; families of processes are four deep

EV = """
ev AS (
  SELECT (event_id + 1) * 8 AS event_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS epoch_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id + 1 AS seq, CAST(user_id + 1000 AS INT) AS pid,
    CAST(CASE WHEN user_id % 4 = 0 THEN 1 ELSE user_id + 999 END AS INT) AS ppid, user_id, k,
    CAST(CASE WHEN k >= 95 THEN k - 92 WHEN k >= 80 THEN 1000 + user_id * 2 + 1 ELSE 1000 + user_id * 2 END AS BIGINT) AS inode,
    CASE event_type WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3
      ELSE CASE WHEN k < 20 THEN 59 WHEN k < 24 THEN 60 WHEN k < 45 THEN 45 WHEN k < 65 THEN 44 WHEN k < 70 THEN 42 WHEN k < 73 THEN 43 WHEN k < 76 THEN 9 WHEN k < 79 THEN 10
                WHEN k < 82 THEN 41 WHEN k < 90 THEN 87 WHEN k < 95 THEN 263 ELSE 231 END END AS syscall
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events)
),
every AS (
  SELECT *, '/home/u' || user_id AS cwd, repeat(chr(CAST(97 + (inode // 10) % 26 AS INT)), 8) || (inode % 10) || '.log' AS fname, 'msg=audit(' || sec || '.000001:' || seq || '):' AS stamp,
    'msg=audit(' || (sec + k % 9) || '.000001:' || seq || '):' AS later, CASE WHEN syscall IN (0, 1, 3) AND k < 6 THEN k % 3 ELSE inode END AS fdno, syscall IN (42, 43, 44, 45) AND k % 2 = 0 AS has_saddr,
    k % 13 <> 0 OR lead(event_id) OVER (PARTITION BY epoch_id ORDER BY event_id) IS NOT NULL AS closed
  FROM ev
),
whole AS (SELECT *, '"' || cwd || '/' || fname || '"' AS exe, lower(to_hex(fdno)) AS fd FROM every),
named AS (SELECT * FROM whole WHERE closed AND syscall NOT IN (9, 10)),
lines AS (
  SELECT event_id, epoch_id, sec, 0 AS at, 'SYSCALL' AS type, 'type=SYSCALL ' || stamp || ' arch=c000003e syscall=' || syscall || CASE WHEN k % 10 = 9 THEN ' success=no' ELSE ' success=yes' END
    || CASE WHEN syscall = 2 THEN ' exit=' || fd WHEN syscall IN (0, 1, 3, 42, 43) THEN ' a0=' || fd WHEN syscall IN (44, 45) THEN ' a0=a' ELSE '' END
    || ' ppid=' || ppid || ' pid=' || pid || ' uid=' || (user_id % 7) || ' exe=' || exe AS value FROM whole
  UNION ALL SELECT event_id, epoch_id, sec, 1, 'CWD', 'type=CWD ' || stamp || ' cwd="' || cwd || '"' FROM whole WHERE syscall IN (2, 87, 263)
  UNION ALL SELECT event_id, epoch_id, sec + k % 9, 2, 'PATH', 'type=PATH ' || later || ' name="' || fname || '" inode=' || inode FROM whole WHERE syscall IN (2, 87, 263)
  UNION ALL SELECT event_id, epoch_id, sec, 3, 'EXECVE', 'type=EXECVE ' || stamp || ' a0="prog' || (user_id % 5) || '"' FROM whole WHERE syscall = 59
  UNION ALL SELECT event_id, epoch_id, sec, 4, 'SOCKADDR', 'type=SOCKADDR ' || stamp || ' saddr=02000050C0A80101' FROM whole WHERE has_saddr
  UNION ALL SELECT event_id, epoch_id, sec, 5, 'EOE', 'type=EOE ' || stamp FROM whole WHERE k % 13 <> 0
),
sizes AS (SELECT event_id, CAST(sum(strlen(value)) AS BIGINT) AS size_bytes, count(*) AS records FROM lines GROUP BY event_id),
owned AS (
  SELECT *, last_value(CASE WHEN syscall = 2 THEN 'file' WHEN syscall = 3 OR has_saddr THEN 'none' END IGNORE NULLS)
    OVER (PARTITION BY epoch_id, pid, CASE WHEN syscall IN (44, 45) THEN 10 WHEN syscall IN (0, 1, 2, 3, 42, 43) THEN fdno END ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner
  FROM named
),
res AS (SELECT *, CASE WHEN syscall IN (2, 87, 263) THEN inode WHEN syscall IN (0, 1, 3) AND (fdno <= 2 OR owner = 'file') THEN fdno END AS file FROM owned),
kept AS (SELECT * FROM res WHERE syscall NOT IN (0, 1, 3) OR file IS NOT NULL),
e0 AS (
  SELECT epoch_id, event_id, pid, syscall,
    CASE WHEN syscall IN (59, 60, 231, 0, 45) THEN 'p' || pid WHEN syscall = 44 THEN 's' ELSE 'i' || file END AS src,
    CASE WHEN syscall IN (59, 60, 231) THEN 'p' || ppid WHEN syscall = 0 THEN 'i' || file WHEN syscall = 45 THEN 's' ELSE 'p' || pid END AS dst,
    CASE WHEN syscall = 59 THEN 'FORKED_BY' WHEN syscall = 2 THEN 'OPENED_BY' WHEN syscall = 3 THEN 'CLOSED_BY' WHEN syscall IN (0, 45) THEN 'USED' WHEN syscall IN (1, 44) THEN 'WAS_GENERATED_BY'
      WHEN syscall IN (87, 263) THEN 'UNLINKED_BY' ELSE 'EXITED_BY' END AS rel
  FROM kept WHERE syscall NOT IN (41, 42, 43)
),
e AS (
  SELECT epoch_id, event_id, pid, syscall, src, dst, rel, CASE WHEN rel IN ('USED', 'WAS_GENERATED_BY') THEN event_id END AS t_s
  FROM (SELECT *, row_number() OVER (PARTITION BY epoch_id, src, dst, rel ORDER BY event_id) AS nth FROM e0) WHERE nth = 1 OR rel NOT IN ('FORKED_BY', 'OPENED_BY', 'CLOSED_BY')
)"""

RUNS = """,
io AS (
  SELECT epoch_id, event_id, pid, CASE WHEN syscall IN (0, 45) THEN 'r' ELSE 'w' END AS op, CASE WHEN syscall IN (44, 45) THEN 's' ELSE 'i' || file END AS object, syscall IN (44, 45) AS is_socket
  FROM kept WHERE syscall IN (0, 1, 44, 45)
),
io1 AS (
  SELECT *, lag(event_id) OVER (PARTITION BY epoch_id, pid, object, op ORDER BY event_id) AS prev,
    max(CASE WHEN op = 'w' THEN event_id END) OVER (PARTITION BY epoch_id, object ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lw,
    max(CASE WHEN op = 'r' THEN event_id END) OVER (PARTITION BY epoch_id, pid ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lr
  FROM io
),
io2 AS (
  SELECT *, sum(CASE WHEN prev IS NOT NULL AND (coalesce(lr, -1) > prev OR (op = 'r' AND coalesce(lw, -1) > prev)) THEN 1 ELSE 0 END) OVER (PARTITION BY epoch_id, pid, object, op ORDER BY event_id) AS run FROM io1
),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY epoch_id, pid, object, op, run ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY epoch_id, pid, object, op, run) AS n, max(run) OVER (PARTITION BY epoch_id, pid, object, op) AS last_run FROM io2
),
rep AS (SELECT epoch_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY epoch_id, pid, file, syscall ORDER BY event_id) AS nth FROM kept WHERE syscall IN (2, 3)) WHERE nth > 1),
redundant AS (SELECT epoch_id, event_id FROM runs WHERE NOT is_socket AND rn > 1 AND rn < n UNION ALL SELECT * FROM rep),
burst AS (SELECT epoch_id, event_id FROM runs WHERE (NOT is_socket AND rn > 1 AND rn < n) OR (rn = n AND run < last_run) OR (rn = 1 AND run > 0) UNION ALL SELECT * FROM rep),
at_once AS (SELECT epoch_id, event_id FROM runs WHERE is_socket AND rn > 1 AND rn < n UNION SELECT epoch_id, event_id FROM kept WHERE syscall IN (0, 1, 3) AND fdno <= 2 UNION SELECT * FROM rep)"""

# Names of one letter differ in a digit and are one cluster; directories of one depth are another.
SHAPES = """,
opened AS (SELECT DISTINCT epoch_id, pid, file FROM kept WHERE syscall = 2),
acc AS (SELECT * FROM kept WHERE syscall IN (0, 1) AND file >= 3),
own AS (
  SELECT DISTINCT epoch_id, a.pid, file, '/home/u' || (a.pid - 1000) AS dir, repeat(chr(CAST(97 + (file // 10) % 26 AS INT)), 8) AS stem, repeat(chr(CAST(97 + (file // 10) % 26 AS INT)), 8) || (file % 10) || '.log' AS name
  FROM acc a JOIN opened USING (epoch_id, pid, file)
),
dirs AS (SELECT epoch_id, CASE WHEN count(DISTINCT dir) > 1 THEN '/home/*' ELSE any_value(dir) END AS dir_shape FROM own GROUP BY epoch_id),
stems AS (SELECT epoch_id, stem, CASE WHEN count(DISTINCT name) > 1 THEN stem || '*.log' ELSE any_value(name) END AS shape FROM own GROUP BY epoch_id, stem),
groups AS (SELECT DISTINCT epoch_id, file, dir_shape, shape FROM own JOIN dirs USING (epoch_id) JOIN stems USING (epoch_id, stem)),
placed AS (
  SELECT epoch_id, event_id, dir_shape, shape, row_number() OVER (PARTITION BY epoch_id, dir_shape, shape, pid, syscall ORDER BY event_id) AS nth FROM acc JOIN groups USING (epoch_id, file)
),
generalised AS (SELECT epoch_id, event_id, CASE WHEN nth = 1 THEN 'MANGLE' ELSE 'DROP' END AS action FROM placed QUALIFY row_number() OVER (PARTITION BY epoch_id, event_id ORDER BY dir_shape, shape) = 1),
approxed AS (SELECT epoch_id, event_id, 'DROP' AS action FROM at_once UNION ALL SELECT * FROM generalised WHERE event_id NOT IN (SELECT event_id FROM at_once))"""

INDUCTION = """,
prog0 AS (SELECT e.epoch_id, e.src AS node, e.pid, '"prog' || (k.user_id % 5) || '"' AS program FROM e JOIN kept k USING (event_id) WHERE e.rel = 'FORKED_BY'),
prog AS (SELECT *, row_number() OVER (PARTITION BY epoch_id, program ORDER BY pid) AS rank, count(*) OVER (PARTITION BY epoch_id, program) AS members FROM prog0),
touch AS (
  SELECT t.*, program, rank, members FROM (
    SELECT epoch_id, event_id, dst AS node, 'in' AS dir, src AS neighbour FROM e WHERE rel NOT IN ('FORKED_BY', 'EXITED_BY')
    UNION ALL SELECT epoch_id, event_id, src, 'out', dst FROM e WHERE rel NOT IN ('FORKED_BY', 'EXITED_BY')) t
  JOIN prog USING (epoch_id, node) WHERE members > 1
),
freq AS (SELECT epoch_id, program, dir, neighbour, members, count(*) AS n FROM touch GROUP BY ALL),
common AS (SELECT epoch_id, program, dir, neighbour FROM freq WHERE n = members),
induced AS (SELECT DISTINCT epoch_id, event_id FROM touch JOIN common USING (epoch_id, program, dir, neighbour) WHERE rank > 1)"""

NODEMERGE = """,
access AS (
  SELECT epoch_id, event_id, pid, exe FROM (SELECT *, max(CASE WHEN syscall = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY epoch_id, exe ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS written FROM kept)
  WHERE syscall <> 1 AND coalesce(written, 0) = 0
),
fap AS (SELECT epoch_id, pid, exe, count(*) AS n FROM access WHERE (epoch_id, exe) NOT IN (SELECT epoch_id, exe FROM kept WHERE syscall = 1) GROUP BY ALL),
fap1 AS (SELECT *, sum(n) OVER (PARTITION BY exe) AS total FROM fap),
fap2 AS (SELECT *, row_number() OVER (PARTITION BY epoch_id, pid ORDER BY total, exe) AS place, count(*) OVER (PARTITION BY epoch_id, pid) AS files FROM fap1),
prefixes AS (SELECT epoch_id, pid, place, files, string_agg(exe, ' ') OVER (PARTITION BY epoch_id, pid ORDER BY place) AS path FROM fap2),
leaf AS (SELECT path, count(*) AS n, any_value(place) AS size FROM prefixes GROUP BY path HAVING count(*) > 1 AND max(files) = any_value(place)),
mined AS (SELECT array_to_string(list_sort(string_split(path, ' ')), ' ') AS template, size, n FROM leaf),
token AS (SELECT DISTINCT template, size, unnest(string_split(template, ' ')) AS exe FROM mined),
fits AS (SELECT epoch_id, pid, files, template, size FROM fap2 JOIN token USING (exe) GROUP BY ALL HAVING count(*) = files),
widest AS (SELECT epoch_id, pid, files, max(size) AS size FROM fits GROUP BY ALL),
merged AS (
  SELECT a.epoch_id, a.event_id FROM (SELECT *, row_number() OVER (PARTITION BY epoch_id, pid ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY epoch_id, pid) AS ids FROM access) a
  JOIN widest USING (epoch_id, pid) WHERE nth <= ids - (size - files)
)"""

TAGGED = """,
hits AS (SELECT epoch_id, event_id FROM kept WHERE fname = 'aaaaaaaa3.log' OR (syscall IN (2, 87, 263) AND ((cwd LIKE '/home/u1%' AND fname LIKE '%7.log%') OR (cwd LIKE '/home/u2%' AND fname LIKE '%aaa4%')))),
hit AS (SELECT e.* FROM e JOIN hits USING (epoch_id, event_id)),
back(epoch_id, n) AS (SELECT epoch_id, dst FROM hit UNION SELECT b.epoch_id, e.dst FROM back b JOIN e ON b.epoch_id = e.epoch_id AND b.n = e.src),
fore(epoch_id, n) AS (SELECT epoch_id, src FROM hit UNION SELECT b.epoch_id, e.src FROM fore b JOIN e ON b.epoch_id = e.epoch_id AND b.n = e.dst),
traced AS (SELECT event_id FROM e JOIN back b ON e.epoch_id = b.epoch_id AND e.src = b.n UNION SELECT event_id FROM e JOIN fore f ON e.epoch_id = f.epoch_id AND e.dst = f.n UNION SELECT event_id FROM hits),
tagged AS (SELECT epoch_id, event_id FROM kept WHERE event_id NOT IN (SELECT event_id FROM traced))"""

#: The fixpoint round by round; a dead file goes if its edges meet one node, a dead process once nothing that stays modifies it.
GARBAGE = (
    """,
dead AS (SELECT DISTINCT epoch_id, src AS node FROM e WHERE rel IN ('EXITED_BY', 'UNLINKED_BY')),
lone AS (SELECT epoch_id, node FROM (SELECT epoch_id, src AS node, dst AS other FROM e UNION SELECT epoch_id, dst, src FROM e) GROUP BY epoch_id, node HAVING count(DISTINCT other) = 1),
gone0 AS (SELECT * FROM dead JOIN lone USING (epoch_id, node) WHERE node LIKE 'i%')"""
    + "".join(
        f""",
gone{k} AS MATERIALIZED (SELECT * FROM gone{k - 1} UNION SELECT * FROM dead WHERE node LIKE 'p%' AND (epoch_id, node) NOT IN (SELECT epoch_id, dst FROM e WHERE rel IN {MODIFYING} AND (epoch_id, src) NOT IN (SELECT * FROM gone{k - 1})))"""
        for k in range(1, ROUNDS + 1)
    )
    + f""",
collected AS (SELECT epoch_id, event_id FROM e WHERE (epoch_id, src) IN (SELECT * FROM gone{ROUNDS}) OR (rel NOT IN {MODIFYING} AND (epoch_id, dst) IN (SELECT * FROM gone{ROUNDS})))"""
)

DECIDED = """,
actions AS (
  SELECT epoch_id, event_id, 'REDUNDANT_IO' AS technique, 'DROP' AS action FROM redundant UNION SELECT *, 'LOG_GC', 'DROP' FROM collected UNION SELECT epoch_id, event_id, 'APPROX', action FROM approxed
  UNION SELECT *, 'INDUCTION', 'DROP' FROM induced UNION SELECT epoch_id, event_id, 'UNSUPPORTED', 'DROP' FROM kept WHERE syscall = 41 UNION SELECT *, 'IBURST', 'DROP' FROM burst UNION SELECT *, 'TAG', 'DROP' FROM tagged
  UNION SELECT *, 'DPRESERVE_FD', 'DROP' FROM not_fd UNION SELECT *, 'DPRESERVE_SD', 'DROP' FROM not_sd UNION SELECT *, 'NODEMERGE', 'DROP' FROM merged
),
decided AS (SELECT epoch_id, event_id, technique FROM actions WHERE action = 'DROP'),
matrix AS (
  SELECT epoch_id, event_id, syscall, {columns} FROM kept k LEFT JOIN (SELECT epoch_id, event_id, {masks} FROM actions GROUP BY ALL) d USING (epoch_id, event_id)
)""".format(
    columns=", ".join(f"coalesce({t}, 0) AS {t}" for t in MATRIX), masks=", ".join(f"max(CASE WHEN technique = '{t}' THEN CASE action WHEN 'DROP' THEN 2 ELSE 1 END ELSE 0 END) AS {t}" for t in MATRIX)
)

CLASS = "CASE WHEN syscall IN (0, 1, 2, 3, 87, 263) THEN 'file' WHEN syscall IN (59, 60, 231) THEN 'process' WHEN syscall IN (41, 42, 43, 44, 45) THEN 'network' ELSE 'other' END"

REQUIRED = """,
{p}es AS (SELECT DISTINCT epoch_id, {src} AS src, {dst} AS dst FROM e),
{p}first AS (SELECT epoch_id, {src} AS src, {dst} AS dst, coalesce(t_s, -1) AS t, event_id FROM e QUALIFY row_number() OVER (PARTITION BY epoch_id, src, dst ORDER BY coalesce(t_s, -1), event_id DESC) = 1),
{p}start AS (SELECT epoch_id, src AS s FROM {p}es UNION SELECT epoch_id, dst FROM {p}es {only}),
{p}reach(epoch_id, s, n) AS (SELECT epoch_id, s, s FROM {p}start UNION SELECT r.epoch_id, r.s, x.dst FROM {p}reach r JOIN {p}es x ON r.epoch_id = x.epoch_id AND r.n = x.src),
{p}need AS (
  SELECT DISTINCT epoch_id, event_id FROM (SELECT f.epoch_id, f.event_id, row_number() OVER (PARTITION BY r.epoch_id, r.s, f.dst ORDER BY f.t, f.event_id DESC) AS k
    FROM {p}reach r JOIN {p}first f ON r.epoch_id = f.epoch_id AND r.n = f.src WHERE r.s <> f.dst) WHERE k = 1
)"""


def _required(p: str, full: bool, turned: bool = False) -> str:
    only = "" if full else f"EXCEPT SELECT epoch_id, dst FROM {p}es"
    return REQUIRED.format(p=p, src="dst" if turned else "src", dst="src" if turned else "dst", only=only)


NOT_SD = _required("s", False) + """,
not_sd AS (SELECT epoch_id, event_id FROM e WHERE event_id NOT IN (SELECT event_id FROM sneed) UNION SELECT * FROM rep)"""
NOT_FD = _required("f", True) + _required("b", True, True) + """,
not_fd AS (SELECT epoch_id, event_id FROM e WHERE event_id NOT IN (SELECT event_id FROM fneed UNION SELECT event_id FROM bneed) UNION SELECT * FROM rep)"""


def _greedy(study: str) -> str:
    """Each step adds the technique that drops most events not dropped yet; ties go to the first in order."""
    steps = f"{study}, masks AS (SELECT {' + '.join(f'CASE WHEN {t} = 2 THEN {1 << k} ELSE 0 END' for k, t in enumerate(MATRIX))} AS mask, count(*) AS n FROM matrix GROUP BY 1), one AS (SELECT unnest({MATRIX}) AS technique, unnest(range({len(MATRIX)})) AS k)"
    steps += ", s0 AS (SELECT 0 AS chosen, '' AS technique, 0 AS gain)"
    for i in range(1, len(MATRIX) + 1):
        steps += f""", s{i} AS MATERIALIZED (SELECT chosen | (1 << CAST(k AS INT)) AS chosen, one.technique, CAST(sum(CASE WHEN mask & chosen = 0 AND (mask >> CAST(k AS INT)) & 1 = 1 THEN n ELSE 0 END) AS BIGINT) AS gain
            FROM one, masks, s{i - 1} GROUP BY chosen, k, one.technique ORDER BY gain DESC, k LIMIT 1)"""
    return steps + " " + " UNION ALL ".join(f"SELECT {i} AS place, technique, gain FROM s{i} WHERE gain > 0" for i in range(1, len(MATRIX) + 1))


def _rq3(part: str, whole: str) -> str:
    terms = {"both": "a = 2 AND b = 2", "either": "a = 2 OR b = 2", "only_first": "a = 2 AND b <> 2", "first": "a = 2"}
    pairs = " UNION ALL ".join(f"SELECT '{x}' AS t1, '{y}' AS t2, {x} AS a, {y} AS b FROM matrix" for x in MATRIX for y in MATRIX if x != y)
    top, low = (f"count(*) FILTER ({terms[x]})" for x in (part, whole))
    return f"SELECT t1, t2, CASE WHEN {low} <> 0 THEN round({top} * 100.0 / {low}, 2) END AS percent FROM ({pairs}) GROUP BY t1, t2"


def _rq4(size: int) -> str:
    return " UNION ALL ".join(f"SELECT '{'+'.join(c)}' AS subset, CAST(count(*) FILTER ({' OR '.join(f'{t} = 2' for t in c)}) AS BIGINT) AS covered FROM matrix" for c in combinations(MATRIX, size))


def oracle_sql() -> dict[str, str]:
    base, runs = f"WITH {EV}", f"WITH {EV}{RUNS}"
    induction, merge = f"WITH {EV}{INDUCTION}", f"WITH {EV}{NODEMERGE}"
    study = f"WITH RECURSIVE {EV[1:]}{RUNS}{SHAPES}{INDUCTION}{NODEMERGE}{TAGGED}{GARBAGE}{NOT_SD}{NOT_FD}{DECIDED}"
    # The flags of open(2) by number.
    bits = "1 O_WRONLY, 2 O_RDWR, 64 O_CREAT, 128 O_EXCL, 256 O_NOCTTY, 512 O_TRUNC, 1024 O_APPEND, 2048 O_NONBLOCK, 4096 O_DSYNC, 8192 O_ASYNC, 16384 O_DIRECT, 65536 O_DIRECTORY, 131072 O_NOFOLLOW, 262144 O_NOATIME, 524288 O_CLOEXEC, 1048576 __O_SYNC, 2097152 O_PATH, 4194304 __O_TMPFILE"
    flags = "concat_ws('|', CASE WHEN v & 3 = 0 THEN 'O_RDONLY' END, " + ", ".join("CASE WHEN v & {} <> 0 THEN '{}' END".format(*x.split()) for x in bits.split(", ")) + ")"
    return {
        "audit_parse": f"{base} SELECT epoch_id, type, count(*) AS records, CAST(sum(strlen(value)) AS BIGINT) AS bytes, min(sec) AS first_second FROM lines GROUP BY epoch_id, type",
        "audit_fields": f"""{base} SELECT epoch_id, event_id, sec AS seconds, syscall, pid, ppid, CASE WHEN syscall IN (0, 1, 2, 3, 42, 43) THEN fdno WHEN syscall IN (44, 45) THEN 10 END AS fd, exe,
            CASE WHEN syscall IN (2, 87, 263) THEN cwd END AS cwd, CASE WHEN syscall IN (2, 87, 263) THEN fname END AS path, CASE WHEN syscall IN (2, 87, 263) THEN inode END AS inode,
            CASE WHEN syscall = 59 THEN '"prog' || (user_id % 5) || '"' END AS program FROM named""",
        "sessionize": f"{base} SELECT epoch_id, event_id, records, closed FROM sizes JOIN whole USING (event_id)",
        "event_size": f"{base} SELECT event_id, size_bytes FROM sizes JOIN named USING (event_id)",
        "fd_resolve": f"{base} SELECT epoch_id, event_id, syscall, pid, file FROM res",
        "drop_unresolved": f"{base} SELECT epoch_id, syscall, count(*) AS n FROM kept GROUP BY epoch_id, syscall",
        "drop_virtual": f"""{base}, v AS (SELECT epoch_id, file, min(event_id) AS since FROM kept WHERE syscall = 2 AND file BETWEEN 3 AND 5 GROUP BY epoch_id, file)
            SELECT k.epoch_id, event_id, syscall FROM kept k LEFT JOIN v USING (epoch_id, file) WHERE syscall NOT IN (0, 1) OR since IS NULL OR event_id <= since""",
        "kernel_rules": f"{base} SELECT syscall, count(*) AS n FROM named WHERE syscall IN (0, 1, 2, 3, 59) AND k % 10 <> 9 AND user_id % 7 <> 0 GROUP BY syscall",
        "epoch_counters": f"{base} SELECT epoch_id, count(*) AS events, CAST(sum(records) AS BIGINT) AS entries, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) FILTER (syscall = 41) AS unsupported FROM named JOIN sizes USING (event_id) GROUP BY epoch_id",
        "edges": f"{base} SELECT epoch_id, event_id, src, dst, rel, t_s FROM e",
        "edges_unlink_twice": f"{base} SELECT epoch_id, rel, CAST(sum(CASE WHEN syscall = 87 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM e GROUP BY epoch_id, rel",
        "nodes": f"""{base} SELECT DISTINCT epoch_id, node, CASE WHEN node = 's' THEN 'socket' WHEN node LIKE 'p%' THEN 'process' ELSE 'inode' END AS kind
            FROM (SELECT epoch_id, src AS node FROM e UNION ALL SELECT epoch_id, dst FROM e)""",
        "node_degree": f"{base} SELECT epoch_id, node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT epoch_id, src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT epoch_id, dst, 0, 1 FROM e) GROUP BY epoch_id, node",
        "redundant_io": f"{runs} SELECT * FROM redundant",
        "iburst": f"{runs} SELECT * FROM burst",
        "repeat_open_close": f"{runs} SELECT * FROM rep",
        "unsupported": f"{base} SELECT epoch_id, event_id FROM kept WHERE syscall = 41",
        "approx_at_once": f"{runs} SELECT * FROM at_once",
        "approx": f"{runs}{SHAPES} SELECT * FROM approxed",
        "wildcard_cluster": f"""{base} SELECT DISTINCT epoch_id, fname AS value, CASE WHEN n > 1 THEN fname[:8] || '*.log' ELSE fname END AS wildcard
            FROM (SELECT epoch_id, fname FROM kept WHERE syscall IN (2, 87, 263)) JOIN (SELECT epoch_id, fname[:8] AS stem, count(DISTINCT fname) AS n FROM kept WHERE syscall IN (2, 87, 263) GROUP BY ALL) s USING (epoch_id) WHERE fname[:8] = stem""",
        "reduced_log": f"{runs} SELECT epoch_id, count(*) AS records, CAST(sum(strlen(value)) AS BIGINT) AS bytes FROM lines WHERE event_id NOT IN (SELECT event_id FROM redundant) GROUP BY epoch_id",
        "reduced_nodes": f"""{runs}, l AS (SELECT * FROM e WHERE event_id NOT IN (SELECT event_id FROM burst))
            SELECT DISTINCT epoch_id, node, CASE WHEN node = 's' THEN 'socket' WHEN node LIKE 'p%' THEN 'process' ELSE 'inode' END AS kind FROM (SELECT epoch_id, src AS node FROM l UNION ALL SELECT epoch_id, dst FROM l)""",
        "induction_freq": f"{induction} SELECT * FROM freq",
        "induction": f"{induction} SELECT * FROM induced",
        "grammar": f"""{induction} SELECT epoch_id, program, dir, string_agg(path, ' ' ORDER BY path) AS files
            FROM (SELECT DISTINCT epoch_id, program, dir, neighbour, '/home/u' || (CAST(node[2:] AS INT) - 1000) || '/' || repeat(chr(CAST(97 + (f // 10) % 26 AS INT)), 8) || (f % 10) || '.log' AS path FROM
              (SELECT t.*, CAST(neighbour[2:] AS BIGINT) AS f FROM touch t JOIN common USING (epoch_id, program, dir, neighbour) WHERE rank = 1 AND neighbour LIKE 'i%') t
              JOIN (SELECT DISTINCT epoch_id, pid, file FROM kept WHERE syscall = 2) o USING (epoch_id) WHERE 'p' || pid = node AND file = f AND f >= 3) GROUP BY epoch_id, program, dir""",
        "fap": f"{merge} SELECT epoch_id, pid, exe, n FROM fap",
        "template_mine": f"{merge} SELECT template, n FROM mined",
        "nodemerge": f"{merge} SELECT * FROM merged",
        "tag_seed": f"WITH RECURSIVE {EV[1:]}{TAGGED} SELECT * FROM hits",
        "tag_trace": f"WITH RECURSIVE {EV[1:]}{TAGGED} SELECT * FROM tagged",
        "dpreserve_sd": f"WITH RECURSIVE {EV[1:]}{_required('f', False)} SELECT epoch_id, event_id FROM e WHERE event_id NOT IN (SELECT event_id FROM fneed)",
        "dpreserve_fd": f"WITH RECURSIVE {EV[1:]}{_required('f', True)}{_required('b', True, True)} SELECT epoch_id, event_id FROM e WHERE event_id NOT IN (SELECT event_id FROM fneed UNION SELECT event_id FROM bneed)",
        "log_gc_batch": f"{base}{GARBAGE} SELECT * FROM collected",
        "levenshtein_pairs": """SELECT a.n_name, b.n_name AS other, CAST(levenshtein(a.n_name, b.n_name) AS INT) AS distance, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 4) AS similarity
            FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_name < b.n_name""",
        "dir_distance": f"""{base}, p AS (SELECT event_id, cwd || '/' || fname AS path, lag(fname) OVER (PARTITION BY pid ORDER BY event_id) AS last, fname, cwd FROM named)
            SELECT event_id, CASE WHEN last = fname THEN 0 ELSE 1 END AS distance, CASE WHEN last = fname THEN path ELSE cwd || '/*' END AS wildcard FROM p WHERE last IS NOT NULL""",
        "open_flags": f"{base} SELECT seq AS event_id, {flags} AS flags FROM (SELECT seq, k * 84017 + seq % 4 AS v FROM ev)",
        "proctitle": "SELECT n_nationkey, n_name || ' -l' AS title FROM nation",
        "ipv4": f"{base} SELECT event_id, CAST(3232235777 AS BIGINT) AS address FROM named WHERE has_saddr",
        "uuid_octal": """SELECT n_nationkey, lower(hex(n_name)) AS uuid, ltrim(CAST((v >> 6) & 7 AS VARCHAR) || CAST((v >> 3) & 7 AS VARCHAR) || CAST(v & 7 AS VARCHAR), '0') AS mode
            FROM (SELECT *, CAST(n_nationkey * 20 + 7 AS BIGINT) AS v FROM nation)""",
        "account_record": """SELECT c_custkey, 'USER_ACCT' AS type, CAST(100.5 AS DOUBLE) AS time, CAST(c_custkey AS VARCHAR) AS pid, 'PAM:accounting' AS op, '"' || c_mktsegment || '"' AS acct, '"/bin/su"' AS exe, 'success' AS res
            FROM customer""",
        "bursting": f"{base} SELECT event_id, records, CASE WHEN syscall IN (2, 87, 263) THEN CAST(k % 9 AS DOUBLE) ELSE 0.0 END AS span, syscall IN (2, 87, 263) AND k % 9 >= 5 AND records >= 3 AS bursting FROM sizes JOIN whole USING (event_id)",
        "decision_rows": f"""{study} SELECT k.epoch_id, k.event_id, sec AS seconds, size_bytes, coalesce(names, '') AS techniques FROM kept k JOIN sizes USING (event_id)
            LEFT JOIN (SELECT event_id, string_agg(DISTINCT technique, ',' ORDER BY technique) AS names FROM decided GROUP BY event_id) USING (event_id)""",
        "dedup_lines": "SELECT DISTINCT event_type || ' ' || props AS value FROM events",
        "epoch_tumbling": "SELECT CAST(floor(epoch(ts) / 30) * 30 AS BIGINT) AS window_start, count(*) AS n FROM events GROUP BY 1",
        "decision_matrix": f"{study} SELECT * FROM matrix",
        "confusion_matrix": f"{study} SELECT a.technique AS t1, b.technique AS t2, count(*) AS n FROM decided a JOIN decided b USING (epoch_id, event_id) GROUP BY 1, 2",
        "reduction_counters": f"""{study} SELECT epoch_id, count(*) AS handled, count(*) FILTER (gone) AS removed, count(*) FILTER (NOT gone) AS kept, CAST(sum(size_bytes) AS BIGINT) AS raw_bytes,
            CAST(coalesce(sum(size_bytes) FILTER (gone), 0) AS BIGINT) AS removed_bytes, CAST(coalesce(sum(size_bytes) FILTER (sd), 0) AS BIGINT) AS technique_bytes
            FROM kept k JOIN sizes USING (event_id) LEFT JOIN (SELECT event_id, bool_or(action = 'DROP') AS gone, bool_or(technique = 'DPRESERVE_SD') AS sd FROM actions GROUP BY event_id) g USING (event_id) GROUP BY epoch_id""",
        "technique_report": f"{study} SELECT technique, count(*) AS dropped, round(count(*) * 100.0 / (SELECT count(DISTINCT event_id) FROM decided), 2) AS percent FROM decided GROUP BY technique",
        "rq4_greedy": _greedy(study),
        "rq1_drop_counts": f"{study} " + " UNION ALL ".join(f"SELECT '{t}' AS technique, CAST(count(*) FILTER ({t} = 2) AS BIGINT) AS dropped FROM matrix" for t in MATRIX),
        "rq2_class_counts": f"{base} SELECT {CLASS} AS class, count(*) AS n FROM kept GROUP BY 1",
        "syscall_class": f"{base} SELECT event_id, syscall, {CLASS} AS class FROM kept",
        "rq2_class_by_technique": f"""{study} SELECT technique, count(*) FILTER (class = 'file') AS file, count(*) FILTER (class = 'network') AS network, count(*) FILTER (class = 'process') AS process,
            count(*) FILTER (class IN ('file', 'network')) AS network_stack, count(*) FILTER (class <> 'other') AS process_stack FROM (SELECT technique, {CLASS} AS class FROM decided JOIN kept USING (epoch_id, event_id)) GROUP BY technique""",
        "rq3_overlap": f"{study} {_rq3('both', 'either')}",
        "rq3_unique_union": f"{study} {_rq3('only_first', 'either')}",
        "rq3_unique_self": f"{study} {_rq3('only_first', 'first')}",
        "rq4_pairs": f"{study} {_rq4(2)}",
        "rq4_triples": f"{study} {_rq4(3)}",
        "cdm_edges": f"""{base}, {CDM} SELECT uuid, CASE WHEN forward THEN s ELSE o END AS src, CASE WHEN forward THEN o ELSE s END AS dst, type FROM c WHERE inode % 14 <> 0 AND type <> 'EVENT_OTHER'""",
        "cdm_vertices": f"""{base} SELECT DISTINCT 's' || pid AS uuid, pid || '|s' || (pid - 1) AS what FROM ev UNION ALL SELECT DISTINCT 'o' || inode, '/data/d' || (inode % 5) || '/f' || inode FROM ev WHERE inode % 7 <> 0
            UNION ALL SELECT DISTINCT 'o' || inode, '80' FROM ev WHERE inode % 14 = 7""",
        "cdm_to_audit": f"""{base}, {CDM}, used AS (SELECT inode, row_number() OVER (ORDER BY min(seq)) + 2 AS number FROM ev WHERE inode % 7 <> 0 GROUP BY inode), who AS (SELECT DISTINCT pid FROM ev),
            r AS (SELECT c.*, number, CASE WHEN p.pid IS NULL THEN 1 ELSE c.pid - 1 END AS parent, 'msg=audit(' || sec || '.000000:0):' AS st, '/data/d' || (inode % 5) AS folder, 'f' || inode AS name FROM c LEFT JOIN used USING (inode) LEFT JOIN who p ON p.pid = c.pid - 1),
            h AS (SELECT *, 'type=SYSCALL ' || st || ' arch=c000003e syscall=' || call AS head, 'type=CWD ' || st || ' cwd="' || folder || '"' AS dir, 'type=PATH ' || st || ' name="' || name || '" inode=' || number AS path, 'type=PROCTITLE ' || st || ' proctitle=DEADBEEF' AS title FROM r),
            a AS (SELECT seq, CASE
              WHEN type IN ('EVENT_OPEN', 'EVENT_CLOSE', 'EVENT_READ', 'EVENT_WRITE', 'EVENT_UNLINK', 'EVENT_EXECUTE') AND number IS NULL THEN []
              WHEN type = 'EVENT_OPEN' THEN [head || ' exit=' || number || ' pid=' || pid, dir, path, title] WHEN type = 'EVENT_CLOSE' THEN [head || ' a0=' || number || ' pid=' || pid]
              WHEN type IN ('EVENT_READ', 'EVENT_WRITE') THEN [head || ' a0=' || number || ' pid=' || pid || ' exe="' || folder || '/' || name || '"'] WHEN type = 'EVENT_UNLINK' THEN [head || ' pid=' || pid, dir, path, title]
              WHEN type = 'EVENT_EXECUTE' THEN [head || ' ppid=' || parent || ' pid=' || pid, 'type=EXECVE ' || st || ' a0="' || name || '"', dir, path, title] WHEN type = 'EVENT_EXIT' THEN [head || ' ppid=' || parent || ' pid=' || pid]
              ELSE [head || ' pid=' || pid] END AS lines FROM h)
            SELECT seq, CAST(unnest(range(len(lines))) AS INT) AS at, unnest(lines) AS value FROM a""",
    }
