"""The engine on a small tree: first build, queries, incremental upkeep, freshness, the stream."""

import os

import pytest

from siftwell.config import CHUNKER_VERSION, EngineConfig
from siftwell.encoders import HashingEncoder
from siftwell.operators import index as ix
from siftwell.plans.engine import EmptyIndex, Engine, NoSuchPath, render, render_page, render_status
from siftwell.schema import LAYOUT
from siftwell.sources import files as fs
from siftwell.streaming.ingest import chunk_stream

TREE = {
    "src/auth.py": "import time\n\n\ndef refresh_access_token(user):\n    token = issue(user)\n    store(token)\n    return token\n\n\ndef issue(user):\n    return user.id\n",
    "src/app.ts": "export function startApp() {\n  refresh_access_token(u);\n  run();\n  log('x');\n}\n",
    "db/schema.sql": "CREATE TABLE sessions (\n  id int,\n  user_id int,\n  expires_at int\n);\n",
    "docs/guide.md": "# Sessions\nHow sessions are refreshed.\n# Other\nText.\n",
    "conf/app.yaml": "a: 1\nb: 2\nc: 3\nd: 4\n",
    "web/app.min.js": "var a=1\n" * 6,
    "package-lock.json": "{}\n" * 6,
    "conf/.env.json": "secret\n" * 6,
    "node_modules/x/a.js": "x\n" * 9,
    ".github/flow.yml": "a\n" * 9,
    "src/small.py": "a = 1\n",
    "bin/tool": "x\n" * 9,
}


@pytest.fixture
def tree(tmp_path):
    for name, text in TREE.items():
        os.makedirs(tmp_path / "tree" / os.path.dirname(name), exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    (tmp_path / "tree/src/bytes.txt").write_bytes(b"ok \xff\xfe fine\nb\nc\nd\n")
    return tmp_path


def test_engine(spark, tree):
    e = Engine(spark, str(tree / "tree"), str(tree / "index"))
    with pytest.raises(EmptyIndex):
        e.search("x")
    done = e.reindex()
    assert done.new == 7 and done.status == "rebuilt"
    hits = e.search("refresh_access_token", top_k=3).collect()
    assert hits[0].symbol == "refresh_access_token" and hits[0]["shape"] == "identifier" and (hits[0].start_line, hits[0].end_line) == (4, 7)
    assert {r.filepath for r in e.search("sessions", category="all", path_filter="DB/").collect()} == {"db/schema.sql"}
    assert "guide.md" in render(e.search("how are the sessions refreshed", category="documentation"))
    with pytest.raises(NoSuchPath):
        e.search("x", path_filter="nowhere")
    with pytest.raises(ValueError, match="category"):
        e.search("x", category="code")
    refs = e.find_symbol_references("refresh_access_token").collect()
    assert [r.kind for r in refs] == ["DEFINITION", "call site"]
    assert e.verify_absence("no_such_thing") == "clean" and e.verify_absence("ISSUE") == "stale"
    assert [r.filepath for r in e.find_symbol_or_keyword("expires_at").collect()] == ["db/schema.sql"]
    assert e.find_symbol_or_keyword("secret").count() == 0
    one = e.get_chunk_content(hits[0].chunk_id).first()
    assert one.text.startswith("def refresh_access_token")
    assert e.get_chunk_content("src/auth.py:gone:1-2").columns == ["chunk_id"]
    assert e.get_file_context([{"path": "src/auth.py", "start_line": 4, "end_line": 5}, {"path": "/etc/passwd"}]).count() == 2
    status = e.status().first()
    assert status.file_count == 7 and status.changed_count == 0 and status.languages["python"] >= 2

    # one file changes, one goes, one comes
    path = tree / "tree/src/auth.py"
    path.write_text(TREE["src/auth.py"] + "\n\ndef revoke(user):\n    return None\n")
    os.utime(path, (os.path.getmtime(path) + 5,) * 2)
    os.remove(tree / "tree/conf/app.yaml")
    (tree / "tree/src/new.py").write_text("def fresh():\n    return 1\n")
    late = e.status().first()
    assert (late.changed_count, late.missing_count, late.added_count, late.changed) == (1, 1, 1, ["src/auth.py"])
    again = e.reindex()
    assert (again.unchanged, again.changed, again.new, again.removed, again.status) == (5, 1, 1, 1, "updated")
    assert e.search("revoke", top_k=1).first().symbol == "revoke"
    assert e.reindex().unchanged == 7
    assert e.status().first().changed_count == 0
    whole = {r.chunk_id for r in e.store.read("chunks").collect()}
    assert {r.chunk_id for r in e.store.read("vectors").collect()} == whole == {r.chunk_id for r in e.store.read("doc_len").collect()}
    e.store.prune([e.store.current()])
    assert e.search("revoke", top_k=1).count() == 1


def test_empty_tree_keeps_the_index(spark, tree):
    e = Engine(spark, str(tree / "tree"), str(tree / "index2"))
    before = e.reindex().chunks
    empty = tree / "none"
    empty.mkdir()
    (empty / "a.bin").write_bytes(b"x")
    other = Engine(spark, str(empty), str(tree / "index2"))
    assert other.reindex(full=True).status.startswith("empty")
    assert e.status().first().chunk_count == before


def test_scan(spark, tree):
    rows = {r.filepath: r for r in fs.scan(spark, str(tree / "tree")).collect()}
    assert set(rows) == {"src/auth.py", "src/app.ts", "db/schema.sql", "docs/guide.md", "conf/app.yaml", "src/small.py", "src/bytes.txt"}
    assert rows["src/bytes.txt"].content.startswith("ok  fine")


def test_repositories(tmp_path):
    for p in ("a/.git", "b/.git", ".hidden/.git", "build/.git", "c"):
        os.makedirs(tmp_path / p)
    assert [os.path.basename(p) for p in fs.discover_repositories(str(tmp_path))] == ["a", "b"]
    assert fs.discover_repositories("", f"{tmp_path}/a:{tmp_path}/a\n{tmp_path}/nope") == [f"{tmp_path}/a"]


def test_two_repositories_in_one_index(spark, tmp_path):
    for name, head in (("one", "a" * 40), ("two", "b" * 40)):
        os.makedirs(tmp_path / f"tree/{name}/.git")
        (tmp_path / f"tree/{name}/.git/HEAD").write_text(head + "\n")
        (tmp_path / f"tree/{name}/run.py").write_text(f"def start_{name}():\n    return shared_name\n")
    e = Engine(spark, str(tmp_path / "tree"), str(tmp_path / "index"))
    assert e.reindex().new == 2
    status = e.status()
    assert status.first().git_heads == {"one": "a" * 40, "two": "b" * 40} and "  two at bbbb" in render_status(status)
    assert {r.filepath for r in e.search("shared_name").collect()} == {"one/run.py", "two/run.py"}
    assert {r.filepath for r in e.search("shared_name", repository="two").collect()} == {"two/run.py"}
    assert {r.filepath for r in e.find_symbol_references("shared_name", repository="one").collect()} == {"one/run.py"}
    with pytest.raises(NoSuchPath):
        e.search("shared_name", repository="thre")
    assert not [p for p in (tmp_path / "index").rglob("scan")]


def test_named_files_alone_are_read(spark, tree):
    root = tree / "tree"
    (root / "src/od[d].py").write_text("a\n")
    (root / "src/auth.py").chmod(0o644)
    names = ["src/auth.py", "src/od[d].py", "src/gone.py", "../tree/src/app.ts", "/etc/passwd", "src", "node_modules/x/a.js", ""]
    rows = fs.scan(spark, str(root), names=names)
    assert sorted(r.filepath for r in rows.collect()) == ["src/auth.py", "src/od[d].py"]
    assert sorted(p.rsplit("/", 1)[1] for p in rows.inputFiles()) == ["a.js", "auth.py", "od%5Bd%5D.py"]  # no other is opened
    assert fs.scan(spark, str(root), names=["gone"]).count() == 0
    context = Engine(spark, str(root), str(tree / "i")).get_file_context([{"path": "src/auth.py", "start_line": 4, "end_line": 4}, {"path": "no"}, {"path": None}, {"path": "/etc/passwd"}]).collect()
    assert sorted((str(r.filepath), r.status) for r in context) == [("/etc/passwd", "outside root"), ("None", "missing path"), ("no", "not found"), ("src/auth.py", "ok")]


def test_stream(spark, tree):
    out, state = str(tree / "out"), str(tree / "state")
    chunk_stream(spark, str(tree / "tree"), out, state).awaitTermination(120)
    n = spark.read.parquet(out).count()
    assert n > 5
    (tree / "tree/src/late.md").write_text("# Late\ntext\n")
    chunk_stream(spark, str(tree / "tree"), out, state).awaitTermination(120)
    assert spark.read.parquet(out).count() == n + 1


class Fragile(HashingEncoder):
    """Fails on one file while `bad` exists; leaves a note for each text that it encodes."""

    def __init__(self, folder):
        super().__init__(8)
        self.folder = str(folder)

    def encode(self, texts):
        for t in texts:
            if "expires_at" in t and os.path.exists(f"{self.folder}/bad"):
                raise RuntimeError("lost")
            with open(f"{self.folder}/seen", "a") as f:
                f.write("x")
        return super().encode(texts)


def test_a_lost_run_is_taken_up(spark, tree):
    (tree / "bad").touch()
    config = EngineConfig(commit_chunks=1, commits_most=4)
    e = Engine(spark, str(tree / "tree"), str(tree / "index3"), Fragile(tree), config)
    with pytest.raises(Exception, match="lost"):
        e.reindex()
    assert e.store.current() is None
    (tree / "bad").unlink()
    (tree / "seen").unlink(missing_ok=True)
    held = ix.Commits(spark, e.store.root, (e.encoder.name, CHUNKER_VERSION, e.root, LAYOUT)).read().count()
    n = e.reindex().chunks
    assert (tree / "seen").stat().st_size == n - held
    assert e.store.read("vectors").count() == n and not [p for p in os.listdir(tree / "index3") if p.startswith("commits=")]
    assert "clean" not in e.describe_references("issue") and "1 of them definitions" in e.describe_references("issue")
    assert "none either" in e.describe_references("no_such_thing")
    assert "1 of 2 match(es); next offset 1" in render_page(e.find_symbol_or_keyword("user_id|expires_at", limit=1))
    assert "up to date" in render_status(e.status())


def test_git_head(tmp_path):
    assert fs.git_head(str(tmp_path)) is None
    os.makedirs(tmp_path / ".git/refs/heads")
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / ".git/packed-refs").write_text("# pack-refs\nabc refs/heads/main\n")
    assert fs.git_head(str(tmp_path)) == "abc"
    (tmp_path / ".git/refs/heads/main").write_text("def\n")
    assert fs.git_head(str(tmp_path)) == "def"
