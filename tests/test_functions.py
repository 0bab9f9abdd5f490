import pytest
from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.operators import cdm, sessions
from auditloom.sources import audit


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_wildcards_and_clusters():
    assert T.wildcard("lantern", "lanterns") == "lantern*"
    assert T.wildcard("lantern", "latern") == "la*tern"
    names = "lantern latern lanterns oats oat oatsy zip".split()
    shapes = T.leader_clusters(names, T.similar, T.wildcard)
    assert shapes["latern"] == shapes["lantern"] == shapes["lanterns"] == "la*tern*" and shapes["oatsy"] == "oat*" and shapes["zip"] == "zip"
    dirs = "/a/bb/c /a/x/c /a/yy/c /q/r/s /m/n /m/o".split()
    shapes = T.leader_clusters(dirs, T.near_dirs, T.merge_dirs)
    assert [shapes[d] for d in dirs] == ["/a/*/c"] * 3 + ["/q/r/s"] + ["/m/*"] * 2


def test_paths_and_decoding(spark):
    lit = F.lit
    assert one(spark, T.dir_distance(lit("/a/bb/c"), lit("/a/yy/c"))) == 1
    assert one(spark, T.dir_distance(lit("/a/bb/c"), lit("/q/r/s"))) == 3
    assert one(spark, T.dir_distance(lit("/a/bb/c"), lit("/m/n"))) == 4097
    assert one(spark, T.proctitle(lit("6c73002d6c"))) == "ls -l"
    assert one(spark, T.hex_number(lit("1f"))) == 31
    assert one(spark, T.construct_path(lit("/a/b"), lit("./c/../d"))) == "/a/b/d"
    assert one(spark, T.construct_path(lit("/a/b"), lit("/x"))) == "/x"
    flags = {"241": "O_WRONLY|O_CREAT|O_TRUNC", "0": "O_RDONLY", "80000": "O_RDONLY|O_CLOEXEC", "3": "O_WRONLY|O_RDWR", "0x700002": "O_RDWR|__O_SYNC|O_PATH|__O_TMPFILE", "zz": "O_RDONLY", "4": "O_RDONLY"}
    for value, names in flags.items():
        assert one(spark, T.open_flags(lit(value))) == names
    assert one(spark, T.open_flags(lit(None).cast("string"))) is None
    assert one(spark, T.ipv4(lit("02000050C0A80101"))) == 0xC0A80101
    assert one(spark, T.ipv4(lit("0200"))) is None and one(spark, T.ipv4(lit("02000050zzzzzzzz"))) is None
    assert one(spark, T.uuid_hex(lit(b"\x01\xab"))) == "01ab" and one(spark, T.octal(lit(0o644))) == "644"
    found = one(spark, T.account_record(lit("type=USER_ACCT msg=audit(7.25:1): pid=9 uid=0 auid=5 ses=1 msg='op=PAM:x acct=\"a b\" exe=\"/bin/su\" res=failed'")))
    assert (found.type, found.time, found.pid, found.acct, found.hostname, found.res) == ("USER_ACCT", 7.25, "9", '"a b"', None, "failed")
    assert one(spark, T.account_record(lit(None).cast("string"))).pid is None
    assert one(spark, T.field(lit("type=X ppid=7 pid=9"), "pid")) == "9"


def test_config_and_files(spark, tmp_path):
    config = audit.load_config("# note\nlog_path=/var/log\nfd_exit_base=10\nunknown=1\n")
    assert (config.log_path, config.fd_exit_base, config.epoch_seconds) == ("/var/log", "10", "30")
    (tmp_path / "t.txt").write_text("b a\nalone\n\nc d e\n")
    assert {r.template: r.tokens for r in audit.read_templates(spark, str(tmp_path / "t.txt")).collect()} == {"b a": ["a", "b"], "c d e": ["c", "d", "e"]}
    (tmp_path / "one.log").write_text("first\nsecond\n\nthird\n")
    (tmp_path / "skip.txt").write_text("no\n")
    rows = audit.read_audit(spark, str(tmp_path)).orderBy("entry_id").collect()
    assert [r.value for r in rows] == ["first", "second", "third"]


def test_sinks(spark, tmp_path):
    rules = spark.createDataFrame([(1, "sh", "in", "i3 i4")], "epoch_id int, program string, dir string, files string")
    audit.write_grammar(rules, f"{tmp_path}/grammar")
    assert [r.value for r in spark.read.text(f"{tmp_path}/grammar").collect()] == ["sh in: i3 i4"]
    audit.write_study({"pairs": rules.select("program", "files")}, f"{tmp_path}/study")
    assert spark.read.option("header", True).csv(f"{tmp_path}/study/pairs").first().asDict() == {"program": "sh", "files": "i3 i4"}


def test_bursting(spark):
    rows = [(0, 1, f"type=PATH msg=audit({k}.5:1):") for k in range(7)] + [(0, 2, "type=SYSCALL msg=audit(1.5:2):"), (0, 3, "nothing")]
    found = sessions.bursting(spark.createDataFrame(rows, "epoch_id int, event_id long, msg string"), records=7)
    assert {r.event_id: (r.records, r.span, r.bursting) for r in found.collect()} == {1: (7, 6.0, True), 2: (1, 0.0, False), 3: (1, 0.0, False)}


def test_sql_functions(spark):
    T.register(spark)
    row = spark.sql("SELECT audit_field('type=X ppid=7 pid=9', 'pid') a, audit_field('x', 'pid') b, open_flags('241') c, dir_distance('/a/b', '/a/c') d, dir_distance('/a', '/a/c') e, dir_wildcard('/a/b', '/a/c') f, path_wildcard('oak', 'oaks') g").first()
    assert tuple(row) == ("9", None, "O_WRONLY|O_CREAT|O_TRUNC", 1, 4097, "/a/*", "oak*")


def test_line_limit(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.log").write_text("".join(f"line {k} {j}\n" for j in range(5)))
    rows = audit.read_audit(spark, str(tmp_path), most_lines=2).collect()
    assert sorted(r.value for r in rows) == ["line 0 0", "line 0 1", "line 1 0", "line 1 1"]


def test_datums_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        audit.read_cdm(spark, f"{tmp_path}/x.csv")
    with pytest.raises(FileNotFoundError):
        audit.read_cdm(spark, f"{tmp_path}/x.json")
    (tmp_path / "d.json").write_text('{"type":"Subject","uuid":"s1","cid":5,"properties":{"name":"sh","cwd":"/r"}}\n{"type":"FileObject","uuid":"o1","baseObject":{"properties":{"path":"/d/f"}}}\n{"type":"NetFlowObject","uuid":"n1","remotePort":9}\n{"type":"Host","uuid":"h"}\n{"type":"EVENT_READ","uuid":"e1","timestampNanos":1000000000,"subject":"s1","predicateObject":"o1"}\n{"type":"EVENT_READ","uuid":"e2","timestampNanos":1,"subject":"s1","predicateObject":"late"}\n{"type":"FileObject","uuid":"late","baseObject":{"properties":{"filename":"/late"}}}\n')
    found = cdm.dispatch(audit.read_cdm(spark, f"{tmp_path}/d.json"))
    assert [(r.pid, r.name, r.cwd) for r in found.processes.collect()] == [(5, "sh", "/r")]
    assert sorted(r.path for r in found.files.collect()) == ["/d/f", "/late"] and found.flows.first().remote_port == 9
    assert [(r.uuid, r.src, r.dst) for r in cdm.edges(found.events, found.vertices()).collect()] == [("e1", "s1", "o1")]
    assert [r.value for r in cdm.to_audit(found.events, found.processes, found.files).collect()] == ['type=SYSCALL msg=audit(1.000000:0): arch=c000003e syscall=0 a0=3 pid=5 exe="/d/f"']
    assert audit.read_cdm(spark, f"{tmp_path}/d.json", limit=2).count() == 2
