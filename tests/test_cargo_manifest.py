"""Dependencies of a Cargo manifest: plain, inline and own tables, targets, renamed packages."""

from sievework.operators import dependencies

MANIFEST = """[package]
name = "x"
version = "1.0"

[dependencies]
serde = "1.0" # for all
tokio = { version = "1.2", features = ["full"] }
local = { path = "../local" }
"quoted-name" = '2'
short = { package = "long-name", version = "3" }
# off = "9"

[dev-dependencies]
proptest = "1"

[target.'cfg(unix)'.dependencies]
nix = "0.27"

[dependencies.rand]
version = "0.8"
default-features = false

[features]
default = "std"
"""


def test_manifest(spark):
    files = spark.createDataFrame([("a/Cargo.toml", MANIFEST), ("b/Cargo.toml", ""), ("c/Cargo.toml", None), ("d/cargo.toml", "[package]\nname = \"y\"")], "path string, content string")
    got = [(r.path, r.ecosystem, r.name, r.version) for r in dependencies.findings(files).orderBy("path", "place").collect()]
    names = [("serde", "1.0"), ("tokio", "1.2"), ("local", None), ("quoted-name", "2"), ("long-name", "3"), ("proptest", "1"), ("nix", "0.27"), ("rand", "0.8")]
    assert got == [("a/Cargo.toml", "crates.io", n, v) for n, v in names]
    assert {r.path: r.status for r in dependencies.statuses(files).collect()} == {"a/Cargo.toml": "read", "b/Cargo.toml": "empty", "c/Cargo.toml": "empty", "d/cargo.toml": "read"}
