import pytest
from pyspark.sql import functions as F

from sievework.operators import dependencies

FILES = {
    "a/Cargo.lock": (
        'version = 3\n[[package]]\nname = "alpha"\nversion = "1.2.3"\nsource = "registry"\n\n[[package]]\nname = "beta"\n[package.source]\nversion = "9"\n',
        [("crates.io", "alpha", "1.2.3"), ("crates.io", "beta", None)],
    ),
    "uv.lock": ('[[package]]\nname = "q"\nversion = "2"\n', [("pypi", "q", "2")]),
    "requirements-dev.txt": (
        "# top\nflask==2.0 # web\nnumpy>=1.2,<2\nplain\nx[extra]~=3.1; python_version > '3'\n-r other.txt\ngit+https://example.com/a.git\n",
        [("pypi", "flask", "2.0"), ("pypi", "numpy", "1.2"), ("pypi", "plain", None), ("pypi", "x", "3.1")],
    ),
    "Pipfile.lock": ('{"default": {"r": {"version": "==2.1"}, "g": {"git": "u"}}, "develop": {"t": {"version": "==3"}}}', [("pypi", "r", "2.1"), ("pypi", "g", None), ("pypi", "t", "3")]),
    "package-lock.json": (
        '{"lockfileVersion": 3, "packages": {"": {"version": "1"}, "node_modules/l": {"version": "4.1"}, "node_modules/l/node_modules/@s/p": {"version": "0.2"}}}',
        [("npm", "l", "4.1"), ("npm", "@s/p", "0.2")],
    ),
    "old/package-lock.json": ('{"lockfileVersion": 1, "dependencies": {"pad": {"version": "1.3"}}}', [("npm", "pad", "1.3")]),
    "yarn.lock": (
        '# yarn lockfile v1\n\n\n"@s/p@^1.0.0", "@s/p@^1.1.0":\n  version "1.1.2"\n  resolved "x"\n\nl@^4:\n  version "4.17"\n',
        [("npm", "@s/p", "1.1.2"), ("npm", "l", "4.17")],
    ),
    "pnpm-lock.yaml": (
        "lockfileVersion: 9.0\n\npackages:\n\n  l@4.17.21:\n    resolution: {}\n\n  '@b/core@7.2.1':\n    resolution: {}\n",
        [("npm", "l", "4.17.21"), ("npm", "@b/core", "7.2.1")],
    ),
    "go.mod": (
        "module e.com/d\n\ngo 1.21\n\nrequire (\n\te.com/a v1.9.1\n\te.com/b v1.8.4 // indirect\n\te.com/c v0.16.0\n)\nrequire e.com/d v2.0.0\n\nreplace e.com/a => e.com/f v1.10.0\nreplace e.com/c => ../c\n",
        [("go", "e.com/a", "v1.10.0"), ("go", "e.com/b", "v1.8.4"), ("go", "e.com/c", None), ("go", "e.com/d", "v2.0.0")],
    ),
    "go.sum": ("e.com/a v1.9.0 h1:x=\ne.com/a v1.9.0/go.mod h1:y=\n", [("go", "e.com/a", "v1.9.0")]),
    "vendor/modules.txt": ("# e.com/a v1.0.0\n## explicit\ne.com/a/sub\n", [("go", "e.com/a", "v1.0.0")]),
    "pom.xml": (
        "<project><properties><v.x>5.1</v.x></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v.x}</version></dependency>"
        "<dependency><groupId>g</groupId><artifactId>b</artifactId><version>${no}</version></dependency></dependencies></project>",
        [("maven", "g:a", "5.1"), ("maven", "g:b", None)],
    ),
    "gradle.lockfile": ("# no\norg.x:core:5.3=compile,run\nempty=\n", [("maven", "org.x:core", "5.3")]),
    "build.gradle": ("dependencies {\n    implementation 'o.x:core:5'\n    api(\"g:h:1-jre\")\n    implementation platform('p:q:3')\n}\n", [("maven", "o.x:core", "5"), ("maven", "g:h", "1-jre"), ("maven", "p:q", "3")]),
    "packages.lock.json": ('{"version": 1, "dependencies": {"net8.0": {"N": {"resolved": "13.0.3"}}, "net8.0/w": {"N": {"resolved": "13.0.3"}}}}', [("nuget", "N", "13.0.3")]),
    "x/App.csproj": (
        '<Project><ItemGroup><PackageReference Include="N.J" Version="13" />\n<PackageReference Include="U">\n<Version>3.1</Version></PackageReference></ItemGroup></Project>',
        [("nuget", "N.J", "13"), ("nuget", "U", "3.1")],
    ),
    "Gemfile.lock": ("GEM\n  specs:\n    rails (7.1.0)\n      act (= 7.1.0)\n    act (7.1.0)\n", [("rubygems", "rails", "7.1.0"), ("rubygems", "act", "7.1.0")]),
    "composer.lock": ('{"packages": [{"name": "l/f", "version": "v10"}], "packages-dev": [{"name": "p/u", "version": "9"}]}', [("packagist", "l/f", "v10"), ("packagist", "p/u", "9")]),
    "Dockerfile": ("FROM --platform=x rust:1.89 AS builder\nRUN make\nFROM builder AS final\nFROM ubuntu@sha256:ab\nFROM scratch\n", [("oci", "rust", "1.89"), ("oci", "ubuntu", "sha256:ab")]),
    "docker-compose.yml": ('services:\n  w:\n    image: "r.example:5000/web:2.0@sha256:de"\n  d:\n    image: postgres:15\n', [("oci", "r.example:5000/web", "sha256:de"), ("oci", "postgres", "15")]),
    ".github/workflows/ci.yml": ("jobs:\n  a:\n    steps:\n      - uses: actions/checkout@v4\n      - name: x\n        uses: o/r/p@abc # c\n      - uses: ./local\n", [("actions", "actions/checkout", "v4"), ("actions", "o/r/p", "abc")]),
    "README.md": ("flask==2.0\n", []),
    "none/Cargo.lock": (None, []),
    "bad/package-lock.json": ("{nope", []),
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, c) for p, (c, _) in FILES.items()], "path string, content string")


def test_each_format(files):
    got: dict = {}
    for r in dependencies.findings(files).orderBy("path", "place").collect():
        got.setdefault(r.path, []).append((r.ecosystem, r.name, r.version))
    for path, (_, want) in FILES.items():
        assert got.get(path, []) == want, path


def test_statuses(files):
    got = {r.path: r.status for r in dependencies.statuses(files).collect()}
    assert got["README.md"] == "unsupported" and got["none/Cargo.lock"] == "empty"
    assert got["bad/package-lock.json"] == "malformed" and got["go.mod"] == got["Pipfile.lock"] == "read"


def test_no_files(files):
    assert dependencies.findings(files.filter(F.lit(False))).collect() == []
