"""Dependencies named by lockfiles and manifests: files in, one row for each dependency out.

Every format is read by Spark's own functions: lines are split and matched, blocks of TOML are
split at their heads, JSON goes through from_json and XML through xpath. A file that can't be
read, or has another name, gives no rows; its status tells which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROW = "array<struct<name:string,version:string>>"
_NPM = "packages map<string, struct<version string>>, dependencies map<string, struct<version string>>"
_COMPOSER = "packages array<struct<name string, version string>>, `packages-dev` array<struct<name string, version string>>"
_PIPFILE = "default map<string, struct<version string>>, develop map<string, struct<version string>>"
_NUGET = "dependencies map<string, map<string, struct<resolved string>>>"


def _found(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), F.nullif(version, F.lit("")).alias("version"))


def _lines(content: Column, pattern: str) -> Column:
    """Lines whose groups 1 and 2 are name and version."""
    lines = F.filter(F.split(content, r"\r?\n"), lambda x: x.rlike(pattern))
    return F.transform(lines, lambda x: _found(F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)))


def _blocks(content: Column) -> Column:
    """TOML tables headed [[package]]; a key counts up to the next head only."""
    value = lambda b, key: F.regexp_extract(F.split(b, r"\n\s*\[", 2)[0], rf'(?m)^{key}\s*=\s*"([^"]*)"', 1)
    blocks = F.slice(F.split(content, r"(?m)^\[\[package\]\]\s*$"), 2, 1 << 20)
    return F.transform(F.filter(blocks, lambda b: value(b, "name") != ""), lambda b: _found(value(b, "name"), value(b, "version")))


def _cargo_manifest(content: Column) -> Column:
    """Entries of the dependency tables, also those of one target, in file order: name = "range",
    name = { version = "range" }, or a table of its own; the name is that of the package where the
    entry renames it, and an entry without a range has none."""
    head = r"""^(?:target\.(?:'[^']*'|"[^"]*"|[^.\]]+)\.)?(?:dev-|build-)?dependencies"""
    sections = F.filter(F.split(content, r"(?m)^\s*\["), lambda x: x.rlike(head + r"(?:\.[^\]]+)?\]"))
    key = lambda x, k: F.regexp_extract(x, rf"""(?:^|[\s{{,]){k}\s*=\s*["']([^"']*)["']""", 1)
    entry = r"""^\s*["']?([A-Za-z0-9_-]+)["']?\s*=\s*(?:["']([^"']*)["']|\{(.*)\})\s*(?:#.*)?$"""

    def renamed(alias, body):
        return F.coalesce(F.nullif(key(body, "package"), F.lit("")), alias)

    def one(x):
        alias, plain, body = (F.regexp_extract(x, entry, k) for k in (1, 2, 3))
        return _found(renamed(alias, body), F.when(plain != "", plain).otherwise(key(body, "version")))

    def rows(x):
        own = F.regexp_extract(x, head + r"""\.["']?([^\]"']+)["']?\]""", 1)
        lines = F.transform(F.filter(F.split(x, r"\r?\n"), lambda y: y.rlike(entry)), one)
        return F.when(own != "", F.array(_found(renamed(own, x), key(x, "version")))).otherwise(lines)

    return F.flatten(F.transform(sections, rows))


def _entries(m: Column, name, version) -> Column:
    return F.transform(F.map_entries(F.coalesce(m, F.create_map().cast(m_type(version)))), lambda e: _found(name(e["key"]), version(e["value"])))


def m_type(version) -> str:
    return "map<string,struct<resolved:string>>" if version is _resolved else "map<string,struct<version:string>>"


def _version(v: Column) -> Column:
    return F.regexp_replace(v["version"], "^==", "")


def _resolved(v: Column) -> Column:
    return v["resolved"]


def _npm(content: Column) -> Column:
    """Version 2 and 3 list packages by folder, the root under an empty one; version 1 by name, of
    which the top level is read."""
    j = F.from_json(content, _NPM)
    folded = F.transform(
        F.filter(F.map_entries(F.coalesce(j["packages"], F.create_map().cast("map<string,struct<version:string>>"))), lambda e: F.contains(e["key"], F.lit("node_modules/"))),
        lambda e: _found(F.regexp_extract(e["key"], r".*node_modules/(.*)$", 1), e["value"]["version"]),
    )
    return F.when(j["packages"].isNotNull(), folded).otherwise(_entries(j["dependencies"], lambda k: k, _version))


def _composer(content: Column) -> Column:
    j = F.from_json(content, _COMPOSER)
    none = F.array().cast(_ROW)
    return F.concat(*[F.coalesce(F.transform(j[k], lambda p: _found(p["name"], p["version"])), none) for k in ("packages", "packages-dev")])


def _pipfile(content: Column) -> Column:
    j = F.from_json(content, _PIPFILE)
    return F.concat(*[_entries(j[k], lambda n: n, _version) for k in ("default", "develop")])


def _nuget(content: Column) -> Column:
    j = F.from_json(content, _NUGET)
    return F.array_distinct(F.flatten(F.transform(F.map_values(F.coalesce(j["dependencies"], F.create_map().cast("map<string,map<string,struct<resolved:string>>>"))), lambda m: _entries(m, lambda n: n, _resolved))))


def _go_mod(content: Column) -> Column:
    """require lines, in and out of a block; a replacement takes the version of its right side, or
    none if that is a folder."""
    plain = F.regexp_replace(content, r"\s*//[^\n]*", "")
    opened = F.concat_ws("\n", F.regexp_extract_all(plain, F.lit(r"(?ms)^require\s*\(([^)]*)\)"), 1), F.regexp_extract_all(plain, F.lit(r"(?m)^require\s+([^(\n]+)$"), 1))
    swaps = F.concat_ws("\n", F.regexp_extract_all(plain, F.lit(r"(?ms)^replace\s*\(([^)]*)\)"), 1), F.regexp_extract_all(plain, F.lit(r"(?m)^replace\s+([^(\n]+)$"), 1))
    pattern = r"^\s*(\S+)(?:\s+\S+)?\s*=>\s*(\S+)(?:\s+(\S+))?\s*$"
    swapped = F.transform(
        F.filter(F.split(swaps, "\n"), lambda x: x.rlike(pattern)),
        lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("old"), F.nullif(F.regexp_extract(x, pattern, 3), F.lit("")).alias("version")),
    )

    def final(r):
        mine = F.filter(swapped, lambda s: s["old"] == r["name"])
        return F.struct(r["name"].alias("name"), F.when(F.size(mine) > 0, F.get(mine, 0)["version"]).otherwise(r["version"]).alias("version"))

    return F.transform(_lines(opened, r"^\s*(\S+)\s+(v\S+)\s*$"), final)


def _pom(content: Column) -> Column:
    """group:artifact of each dependency; a version that is a property is looked up in properties."""
    deps = F.regexp_extract_all(content, F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)
    tag = lambda x, t: F.trim(F.regexp_extract(x, rf"(?s)<{t}>(.*?)</{t}>", 1))

    def version(x):
        raw = tag(x, "version")
        key = F.regexp_extract(raw, r"^\$\{(.+)\}$", 1)
        at = F.concat(F.lit("<"), key, F.lit(">"))
        known = F.substring_index(F.call_function("substring_index", content, at, F.lit(-1)), "<", 1)
        return F.when(key == "", raw).when(F.contains(content, at), F.trim(known))

    return F.transform(deps, lambda x: _found(F.concat(tag(x, "groupId"), F.lit(":"), tag(x, "artifactId")), version(x)))


def _csproj(content: Column) -> Column:
    refs = F.regexp_extract_all(content, F.lit(r"(?s)<PackageReference\s[^>]*?(?:/>|>.*?</PackageReference>)"), 0)
    version = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r'\bVersion="([^"]*)"', 1), F.lit("")), F.regexp_extract(x, r"<Version>([^<]*)</Version>", 1))
    return F.transform(refs, lambda x: _found(F.regexp_extract(x, r'\bInclude="([^"]*)"', 1), version(x)))


def _yarn(content: Column) -> Column:
    """Blocks of yarn: a head that names the package, then its version, quoted or not."""
    head = r'^"?(@?[^@"\s,]+)@[^\n]*:[ \t]*\n'
    blocks = F.filter(F.split(content, r"\n(?=[^\s#])"), lambda b: b.rlike(head) & b.rlike(r"\n  version:?\s"))
    return F.transform(blocks, lambda b: _found(F.regexp_extract(b, head, 1), F.regexp_extract(b, r'\n  version:?\s+"?([^"\s]+)', 1)))


def _images(content: Column, pattern: str) -> Column:
    """image[:tag][@digest]: the digest is the version if there is one, else the tag. A port in the
    registry's name is no tag."""
    refs = F.regexp_extract_all(content, F.lit(pattern), 1)
    name = lambda x: F.regexp_replace(F.substring_index(x, "@", 1), r":[^/:]+$", "")
    tag = lambda x: F.regexp_extract(F.substring_index(x, "@", 1), r":([^/:]+)$", 1)
    return F.transform(refs, lambda x: _found(name(x), F.when(F.contains(x, F.lit("@")), F.substring_index(x, "@", -1)).otherwise(tag(x))))


def _docker(content: Column) -> Column:
    """FROM lines but for scratch and earlier stages of the same file."""
    stages = F.regexp_extract_all(content, F.lit(r"(?im)^\s*FROM\s+.*\sAS\s+(\S+)\s*$"), 1)
    return F.filter(_images(content, r"(?im)^\s*FROM\s+(?:--\S+\s+)*(\S+)"), lambda r: (r["name"] != "scratch") & ~F.array_contains(stages, r["name"]))


# File name (lower case) or its ending -> (ecosystem, reader).
READERS = [
    (r"^cargo\.lock$", "crates.io", _blocks),
    (r"^cargo\.toml$", "crates.io", _cargo_manifest),
    (r"^(poetry|uv)\.lock$", "pypi", _blocks),
    (r"^requirements.*\.(txt|in)$", "pypi", lambda c: _lines(c, r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(?:(?:===?|>=|<=|~=|!=|<|>)\s*([^\s;#,]+))?[^:/]*$")),
    (r"^pipfile\.lock$", "pypi", _pipfile),
    (r"^(package-lock|npm-shrinkwrap)\.json$", "npm", _npm),
    (r"^yarn\.lock$", "npm", _yarn),
    (r"^pnpm-lock\.yaml$", "npm", lambda c: F.array_distinct(_lines(c, r"^  ['\"]?/?(@?[^@'\"\s]+)@([^:('\"]+)[^:]*['\"]?:\s*(?:\{\})?$"))),
    (r"^go\.mod$", "go", _go_mod),
    (r"^go\.sum$", "go", lambda c: F.array_distinct(_lines(c, r"^(\S+)\s+(v[^\s/]+)(?:/go\.mod)?\s+h1:"))),
    (r"^modules\.txt$", "go", lambda c: _lines(c, r"^# (\S+) (v\S+)")),
    (r"^pom\.xml$", "maven", _pom),
    (r"^gradle\.lockfile$", "maven", lambda c: _lines(c, r"^([^#:\s]+:[^:\s]+):([^=\s]+)=")),
    (r"^build\.gradle(\.kts)?$", "maven", lambda c: _lines(c, r"^\s*[A-Za-z]+\s*\(?(?:platform\s*\()?\s*['\"]([^:'\"]+:[^:'\"]+):([^'\"]+)['\"]")),
    (r"^packages\.lock\.json$", "nuget", _nuget),
    (r"\.csproj$", "nuget", _csproj),
    (r"^gemfile\.lock$", "rubygems", lambda c: _lines(c, r"^    (\S+) \(([^)=<>~]+)\)$")),
    (r"^composer\.lock$", "packagist", _composer),
    (r"^dockerfile(\..*)?$", "oci", _docker),
    (r"^(docker-)?compose(\..*)?\.ya?ml$", "oci", lambda c: _images(c, r"(?m)^\s*image:\s*['\"]?([^'\"\s#]+)")),
    (r"^.*\.ya?ml$", "actions", lambda c: _lines(c, r"^\s*(?:-\s*)?uses:\s*['\"]?([^@'\"\s]+)@([^'\"\s#]+)")),
]
_JSON = "^(package-lock|npm-shrinkwrap|packages\\.lock)\\.json$|^(pipfile|composer)\\.lock$"


def findings(files: DataFrame) -> DataFrame:
    """path, ecosystem, place, name, version: the dependencies that each file names, in file order.

    files: path, content. The file's name picks the reader, so only that one's expressions run on a
    row. Version is null where the file gives none. Null content counts as empty."""
    file = F.lower(F.substring_index("path", "/", -1))
    content = F.coalesce("content", F.lit(""))
    eco, rows = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.array().cast(_ROW))
    for name, ecosystem, reader in READERS:
        eco, rows = eco.when(file.rlike(name), ecosystem), rows.when(file.rlike(name), reader(content).cast(_ROW))
    return files.select("path", eco.alias("ecosystem"), F.posexplode(rows).alias("place", "r")).select("path", "ecosystem", "place", "r.name", "r.version")


def statuses(files: DataFrame) -> DataFrame:
    """path, status: unsupported (no reader has the name), empty, malformed (JSON that is none) or read."""
    file = F.lower(F.substring_index("path", "/", -1))
    known = F.exists(F.array(*[file.rlike(name) for name, _, _ in READERS]), lambda b: b)
    blank = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")) == ""
    bad = file.rlike(_JSON) & F.expr("try_parse_json(content)").isNull()
    return files.select("path", F.when(~known, "unsupported").when(blank, "empty").when(bad, "malformed").otherwise("read").alias("status"))
