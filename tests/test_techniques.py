import random
import socket
import threading
import time

import pytest

from auditloom.operators import analysis, cdm, closure, sessions, techniques
from auditloom.sources import audit
from auditloom.streaming import epochs

COLUMNS = "epoch_id long, event_id long, syscall int, pid int, ppid int, file long, fd long, exe string, cwd string, path string, program string, saddr string"


def ctx(spark, rows):
    """Rows are (event_id, syscall, pid, file)."""
    return techniques.context(spark.createDataFrame([(0, e, c, p, 1, f, 5, f'"f{f}"', "/d", f"f{f}", '"sh"' if c == 59 else None, None) for e, c, p, f in rows], COLUMNS))


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


@pytest.mark.parametrize(
    "rows, redundant, burst",
    [
        ([(20, 0, 7, 50), (30, 0, 7, 50), (40, 0, 7, 50), (50, 0, 7, 50)], [30, 40], [30, 40]),
        ([(20, 0, 7, 50), (30, 0, 7, 50), (35, 1, 8, 50), (40, 0, 7, 50), (50, 0, 7, 50)], [], [30, 40]),
        ([(20, 0, 7, 50), (30, 0, 7, 50), (35, 0, 7, 51), (40, 0, 7, 50), (50, 0, 7, 50)], [], [30, 40]),
        ([(20, 1, 7, 50), (30, 1, 7, 50), (40, 1, 7, 50)], [30], [30]),
        ([(20, 1, 7, 50), (25, 0, 7, 51), (30, 1, 7, 50), (40, 1, 7, 50)], [], [20, 30]),
        ([(10, 2, 7, 50), (20, 2, 7, 50)], [20], [20]),
    ],
)
def test_micro_traces(spark, rows, redundant, burst):
    c = ctx(spark, rows)
    assert (ids(techniques.redundant_io(c)), ids(techniques.iburst(c))) == (redundant, burst)


def test_socket_runs(spark):
    """The inside of a socket's run is dropped by generalisation only; both sides of its breaks are burst drops like a file's."""
    rows = [(10, 45, 7, None), (20, 45, 7, None), (30, 45, 7, None), (35, 44, 8, None), (40, 45, 7, None), (50, 45, 7, None), (60, 44, 8, None), (65, 0, 8, 50), (70, 44, 8, None)]
    c = ctx(spark, rows)
    assert ids(techniques.redundant_io(c)) == []
    assert ids(techniques.iburst(c)) == sorted(simulate_sockets(rows))
    assert ids(techniques.approx_at_once(c)) == [20]


def simulate_sockets(rows):
    """Burst drops, one event at a time: a break drops the last access before it and the first after it."""
    last, dropped, writes, reads = {}, set(), {}, {}
    for e, c, p, f in rows:
        thing = "s" if c in (44, 45) else f
        reading = c in (0, 45)
        key = (p, thing, reading)
        if key in last:
            prev = last[key]
            if reads.get(p, -1) > prev or (reading and writes.get(thing, -1) > prev):
                dropped |= {prev, e}
        last[key] = e
        if reading:
            reads[p] = e
        else:
            writes[thing] = e
    return dropped


def simulate(rows):
    """The run rule, one event at a time."""
    runs, redundant, writes, reads = {}, set(), {}, {}
    for e, c, p, f in rows:
        key = (p, f, c)
        if key in runs:
            prev = runs[key][-1]
            broken = reads.get(p, -1) > prev or (c == 0 and writes.get(f, -1) > prev)
            if broken:
                runs[key] = [e]
            else:
                if len(runs[key]) > 1:
                    redundant.add(prev)
                runs[key].append(e)
        else:
            runs[key] = [e]
        (reads if c == 0 else writes)[p if c == 0 else f] = e
    return sorted(redundant)


def test_runs_match_simulation(spark):
    rng = random.Random(3)
    rows = [(10 * k, rng.choice([0, 1]), rng.choice([7, 8]), rng.choice([50, 51])) for k in range(1, 400)]
    assert ids(techniques.redundant_io(ctx(spark, rows))) == simulate(rows)


def test_induction_and_nodemerge(spark):
    forks = [(1, 59, 7, None), (2, 59, 8, None)]
    opens = [(3, 2, 7, 50), (4, 2, 8, 50)]
    c = ctx(spark, forks + opens + [(5, 0, 7, 50), (6, 0, 8, 50)])
    assert ids(techniques.induction(c)) == [4, 6]
    c = ctx(spark, forks + opens + [(5, 0, 7, 50), (6, 0, 8, 50), (7, 0, 8, 50)])
    assert ids(techniques.induction(c)) == [4]
    c = ctx(spark, [(1, 0, 7, 1), (2, 0, 7, 2)])
    templates = spark.createDataFrame([(['"f1"', '"f2"', '"f3"'],)], "tokens array<string>")
    assert ids(techniques.nodemerge(c, templates)) == [1]


def needed(edges, sources):
    """The rule of dependence, source by source."""
    out = set()
    for s in sources:
        seen, waiting = {s}, [s]
        while waiting:
            x = waiting.pop()
            for _, a, b, _ in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    waiting.append(b)
        for n in seen - {s}:
            best = None
            for e, a, b, t in edges:
                if b == n and a in seen and (best is None or t <= best[0]):
                    best = (t, e)
            out.add(best[1])
    return out


def test_dependence_on_random_graphs(spark):
    rng = random.Random(9)
    every, want_sd, want_fd = [], {}, {}
    for epoch in range(25):
        edges = []
        for e in range(1, rng.randint(3, 22)):
            a, b = rng.sample("abcdefg", 2)
            edges.append((e, a, b, e if rng.random() < 0.7 else -1))
        every += [(epoch, e, a, b, None if t == -1 else t) for e, a, b, t in edges]
        nodes = {x for _, a, b, _ in edges for x in (a, b)}
        back = [(e, b, a, t) for e, a, b, t in edges]
        want_sd[epoch] = {e[0] for e in edges} - needed(edges, nodes - {b for _, _, b, _ in edges})
        want_fd[epoch] = {e[0] for e in edges} - needed(edges, nodes) - needed(back, nodes)
    df = spark.createDataFrame(every, "epoch_id long, event_id long, src string, dst string, t_s long")
    for found, want in ((closure.dpreserve_sd(df), want_sd), (closure.dpreserve_fd(df), want_fd)):
        assert {(r.epoch_id, r.event_id) for r in found.collect()} == {(k, e) for k, v in want.items() for e in v}
    assert all(want_fd[k] <= want_sd[k] for k in want_fd)


def test_garbage(spark):
    rows = [(1, 2, 7, 50), (2, 1, 7, 50), (3, 87, 7, 50), (4, 231, 7, None)]
    c = ctx(spark, rows)
    assert ids(techniques.log_gc_batch(c)) == [1, 2, 3, 4]
    assert ids(techniques.log_gc(c)) == [1, 2, 3, 4]


def test_sessions(spark):
    lines = ["type=CWD x", "type=SYSCALL msg=audit(5.1:1): syscall=2 pid=3 exit=a", "type=PATH name=\"f\" inode=9", "type=EOE", "type=PATH lost", "type=SYSCALL msg=audit(6.1:2): syscall=0 pid=3 a0=a", "type=SYSCALL msg=audit(7.1:3): syscall=0 pid=3 a0=b"]
    df = spark.createDataFrame([(k, 0, x) for k, x in enumerate(lines)], "entry_id long, epoch_id long, value string")
    events = sessions.resolve(sessions.events_of(sessions.sessionize(sessions.parse(df))))
    found = {r.event_id: (r.syscall, r.file) for r in events.collect()}
    assert found == {1: (2, 9), 5: (0, 9)}  # the last event has no end


def test_study(spark):
    hist = spark.createDataFrame([(3, "file", 4), (1, "file", 2), (2, "file", 5), (0, "other", 9)], "mask int, class string, n long")
    pairs = {(r.t1, r.t2): (r.both, r.either, r.only_first, r["first"]) for r in analysis.pairwise(hist, ["A", "B"]).collect()}
    assert pairs == {("A", "B"): (4, 11, 2, 6), ("B", "A"): (4, 11, 5, 9)}
    assert [(r.technique, r.gain) for r in analysis.greedy(hist, ["A", "B"]).orderBy("place").collect()] == [("B", 9), ("A", 2)]
    assert analysis.coverage(hist, ["A", "B"], 2).first().covered == 11


def test_cdm_lines(spark):
    events = spark.createDataFrame([(1, "e1", "EVENT_OPEN", 10**9, "s1", "o1"), (2, "e2", "EVENT_READ", 2 * 10**9, "s1", "o1"), (3, "e3", "EVENT_EXIT", 3 * 10**9, "s1", None)], "seq long, uuid string, type string, nanos long, subject string, object string")
    subjects = spark.createDataFrame([(0, "s1", 77, "gone")], "seq long, uuid string, pid int, parent string")
    files = spark.createDataFrame([(0, "o1", "/home/admin/profile")], "seq long, uuid string, path string")
    lines = [r.value for r in cdm.to_audit(events, subjects, files).orderBy("seq", "at").collect()]
    assert lines[0] == "type=SYSCALL msg=audit(1.000000:0): arch=c000003e syscall=2 exit=3 pid=77"
    assert lines[2] == 'type=PATH msg=audit(1.000000:0): name="profile" inode=3'
    assert lines[4].endswith('syscall=0 a0=3 pid=77 exe="/home/admin/profile"') and lines[5].endswith("syscall=60 ppid=1 pid=77")


def test_stream_epochs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.log").write_text("type=SYSCALL msg=audit(5.1:1): syscall=2 pid=3 exit=a\ntype=PATH name=\"f\" inode=9\ntype=EOE\n")
    seen = []
    lines = epochs.read_lines(spark, str(tmp_path / "in"), 1)
    query = epochs.run_epochs(lines, lambda events, number: seen.append(events.count()), str(tmp_path / "state"), seconds=None)
    query.awaitTermination()
    assert seen == [1, 1]


LOG = """type=SYSCALL msg=audit(5.1:1): syscall=59 ppid=1 pid=3
type=EXECVE a0="sh"
type=EOE
type=SYSCALL msg=audit(5.2:2): syscall=2 pid=3 exit=a
type=CWD cwd="/data"
type=PATH name="name1.log" inode=9
type=EOE
type=SYSCALL msg=audit(5.3:3): syscall=0 pid=3 a0=a exe="x"
type=EOE
type=SYSCALL msg=audit(5.4:4): syscall=0 pid=3 a0=a exe="x"
type=EOE
type=SYSCALL msg=audit(5.5:5): syscall=0 pid=3 a0=a exe="x"
type=EOE
type=SYSCALL msg=audit(5.6:6): syscall=87 pid=3
type=PATH name="name1.log" inode=9
type=EOE
type=SYSCALL msg=audit(5.7:7): syscall=231 ppid=1 pid=3
type=EOE
"""


def decided(resolved, names=None):
    c = techniques.context(resolved)
    return {(r.epoch_id, r.event_id, r.technique): r.action for r in techniques.decide(c, names).collect()}


def test_every_technique_on_a_log_and_on_a_stream(spark, tmp_path):
    """A file's epoch is its path; a stream's without files is a number: every technique takes both."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(LOG)
    rows = sessions.drop_unresolved(sessions.resolve(sessions.events_of(sessions.sessionize(sessions.parse(audit.read_audit(spark, str(tmp_path / "in")))))))
    ids_of = [r.event_id for r in rows.orderBy("event_id").collect()]
    found = decided(rows, list(techniques.REGISTRY))
    assert {e for e, _, _ in found} == {rows.first().epoch_id}
    by = lambda t, a="DROP": [ids_of.index(e) for _, e, x in sorted(k for k, v in found.items() if v == a) if x == t]
    assert by("REDUNDANT_IO") == [3] and by("IBURST") == [3] and by("APPROX", "MANGLE") == [2] and by("APPROX") == [3, 4]
    assert by("LOG_GC") == [0, 1, 2, 3, 4, 5, 6] or set(by("LOG_GC")) >= {1, 2, 3, 4, 5, 6}
    exact = techniques.log_gc(techniques.context(rows)).collect()
    assert {r.epoch_id for r in exact} == {rows.first().epoch_id}
    seen = []
    lines = epochs.read_lines(spark, str(tmp_path / "in"), 1)
    query = epochs.run_epochs(lines, lambda e, k: seen.append(decided(sessions.drop_unresolved(e))), str(tmp_path / "state"), seconds=None)
    query.awaitTermination()
    assert seen == [{k: v for k, v in found.items() if k[2] in techniques.ACTIVE}]


def test_first_action_wins(spark):
    rows = spark.createDataFrame([(0, 1, "A", "1", "MANGLE"), (0, 1, "A", "0", "DROP"), (0, 2, "A", "1", "MANGLE"), (0, 2, "A", "2", "DROP")], "epoch_id int, event_id int, technique string, place string, action string")
    assert {r.event_id: r.action for r in analysis.first_action(rows).collect()} == {1: "DROP", 2: "MANGLE"}


def test_lines_from_a_unix_socket(spark, tmp_path):
    path = str(tmp_path / "s")
    server = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
    server.bind(path)
    server.listen(4)

    def send():
        while True:
            try:
                c, _ = server.accept()
            except OSError:
                return
            c.sendall(LOG.encode())

    threading.Thread(target=send, daemon=True).start()
    seen = []
    query = epochs.run_epochs(epochs.read_unix(spark, path), lambda e, k: seen.extend(r.syscall for r in e.orderBy("event_id").collect()), str(tmp_path / "state"), seconds=1)
    limit = time.time() + 60
    while len(seen) < 7 and time.time() < limit and query.exception() is None:
        time.sleep(0.5)
    query.stop()
    server.close()
    assert seen[:7] == [59, 2, 0, 0, 0, 87, 231]
