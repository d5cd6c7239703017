import subprocess

import pytest
from quillforge.plans import rename
from quillforge.sources import edits, git

TREE = {
    "pkg/a.py": "import os\n\nclass Worker:\n    def run(self):\n        return self.run\n\nclass Other:\n    def run(self): pass\n\ndef é(): pass\n\n@os.x\ndef go(n):\n    return go(n - 1)\n",
    "pkg/b.py": "from pkg.a import go as g, Worker, go\n\nclass Sub(Worker):\n    def run(self):\n        return super().run()\n\ndef use(w: 'Worker', o):\n    x = Worker()\n    x.run(); w.run(); o.run(); Worker.run(x)\n    return go(1)\n",
    "pkg/c.py": "def go(): pass\ngo()\n",
    "pkg/bad.py": "def go(:\n",
    "pkg/d.py": "x = 1",
}


@pytest.fixture()
def files(spark):
    return spark.createDataFrame([(p, "python", s) for p, s in TREE.items()], "path string, language string, source string")


def apply(planned):
    after = dict(TREE)
    made = rename.to_edits(planned)
    for path in {e.path for e in made}:
        after[path] = edits.apply_to(TREE[path].encode(), [e for e in made if e.path == path]).decode()
    return after


def test_rename_function(files):
    after = apply(rename.plan(files, "pkg/a.py::go", "start"))
    assert after["pkg/a.py"] == TREE["pkg/a.py"].replace("def go", "def start").replace("return go", "return start")
    assert after["pkg/b.py"] == TREE["pkg/b.py"].replace("import go as g, Worker, go", "import start as g, Worker, start").replace("return go(1)", "return start(1)")
    assert after["pkg/c.py"] == TREE["pkg/c.py"] and after["pkg/bad.py"] == TREE["pkg/bad.py"]


def test_rename_method_follows_types(files):
    after = apply(rename.plan(files, "pkg/a.py::Worker.run", "execute"))
    assert "def execute(self):\n        return self.execute" in after["pkg/a.py"] and "class Other:\n    def run" in after["pkg/a.py"]
    assert "x.execute(); w.execute(); o.run(); Worker.execute(x)" in after["pkg/b.py"] and "super().execute()" in after["pkg/b.py"]


def test_move(files):
    after = apply(rename.plan(files, "pkg/a.py::go", "start", "pkg/d.py"))
    assert after["pkg/d.py"] == "x = 1\n@os.x\ndef start(n):\n    return start(n - 1)\n" and "go" not in after["pkg/a.py"]
    with pytest.raises(edits.EditError, match="already defines"):
        rename.plan(files, "pkg/a.py::go", "go", "pkg/c.py")


def test_refusals(files):
    for query, new in (("pkg/a.py", "x"), ("pkg/a.py::a.b.c", "x"), ("a.rs::go", "x"), ("pkg/a.py::go", "class"), ("pkg/a.py::go", "a-b")):
        with pytest.raises(ValueError):
            rename.plan(files, query, new)
    with pytest.raises(ValueError):
        rename.plan(files, "pkg/a.py::Worker.run", "x", "pkg/d.py")
    with pytest.raises(edits.EditError):
        rename.plan(files, "pkg/a.py::nothing", "x")
    with pytest.raises(edits.EditError, match="overlap"):
        edits.check([edits.Edit("a", 0, 5, ""), edits.Edit("a", 4, 6, "")])


def test_edits_are_written_together(tmp_path):
    (tmp_path / "a").write_text("one two")
    (tmp_path / "b").write_text("three")
    with pytest.raises(edits.EditError):
        edits.apply(str(tmp_path), [edits.Edit("a", 0, 3, "1", "one"), edits.Edit("b", 0, 5, "3", "other")])
    assert (tmp_path / "a").read_text() == "one two"
    assert edits.apply(str(tmp_path), [edits.Edit("a", 0, 3, "1", "one"), edits.Edit("a", 4, 7, "2", "two")]) == ["a"]
    assert (tmp_path / "a").read_text() == "1 2"


def test_changed_files(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    (tmp_path / "a.py").write_text("1")
    run("add", "-A")
    run("commit", "-m", "first")
    run("checkout", "-b", "work")
    (tmp_path / "b.py").write_text("2")
    run("add", "-A")
    run("commit", "-m", "second")
    (tmp_path / "a.py").write_text("3")
    (tmp_path / "c.py").write_text("4")
    base = git.fork_point(str(tmp_path), "main", "gone")
    assert [r.file for r in git.changed_files(spark, str(tmp_path)).orderBy("file").collect()] == ["a.py", "c.py"]
    assert [r.file for r in git.changed_files(spark, str(tmp_path), base).orderBy("file").collect()] == ["a.py", "b.py", "c.py"]
