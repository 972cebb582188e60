"""Inventories of folders: what is kept, and that what is left out is in no task."""

import pytest

from sievework.sources import workspace


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("a +b%20é") / "top"
    files = {"src/main.rs": "fn main() {}\n", "src/a b+c%41é.py": "x\n", "docs/x.md": "# é\n", "target/debug/x.rs": "no", ".git/config": "no", "big.txt": "x" * 5000, "pic.png": "no", "gen/keep.rs": "k", "gen/a.rs": "no", "empty.toml": "", "top/main.rs": "t"}
    for path, said in files.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(said, encoding="utf-8")
    (top / "bytes.txt").write_bytes(b"a\xffb")
    return str(top)


RULES = ["gen/*", "!gen/keep.rs", "", "# none"]
KEPT = ["bytes.txt", "docs/x.md", "gen/keep.rs", "src/a b+c%41é.py", "src/main.rs", "top/main.rs"]


def scanned(df):
    df._jdf.collectToPython()
    plan = df._jdf.queryExecution().executedPlan()
    while not plan.children().isEmpty():
        plan = plan.children().head()
    return plan.metrics().apply("numFiles").value()


def test_inventory(spark, root):
    rows = {r.path: r for r in workspace.inventory(spark, root, RULES, most_bytes=4000).collect()}
    assert sorted(rows) == KEPT
    assert (rows["src/main.rs"].language, rows["src/main.rs"].role, rows["src/main.rs"].size) == ("rust", "implementation", 13)


def test_contents_of_what_is_left_out_are_not_scanned(spark, root):
    df = workspace.contents(spark, root, RULES, most_bytes=4000)
    texts = {r.path: r.text for r in df.collect()}
    assert sorted(texts) == KEPT and texts["docs/x.md"] == "# é\n" and texts["bytes.txt"] == "a�b"
    assert scanned(workspace.contents(spark, root, RULES, most_bytes=4000)) == len(KEPT)
    listing = workspace.inventory(spark, root, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in listing.split("ReadSchema")[1]


def test_no_files_and_no_folder(spark, root, tmp_path):
    assert workspace.inventory(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        workspace.inventory(spark, str(tmp_path / "none")).collect()
