"""Files and folders that matter in a repository, and checks of requests, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import queries

# Kinds of files in the order in which they are told, each with its reason and the file
# names (in lower case, a star for any ending) or, with a slash before them, whole paths that it has.
FILES = [
    ("readme", "readme_file", "readme readme.*"),
    ("security", "security_policy", "security.md security.txt"),
    ("contributing", "contributing_guide", "contributing.md contributing"),
    ("changelog", "changelog_file", "changelog changelog.* changes changes.* history history.*"),
    ("license", "license_file", "license license.* license-* licence licence.* licence-* copying copying.*"),
    ("ci_config", "github_actions_workflow", "/.github/workflows/*"),
    ("ci_config", "gitlab_ci_config", "/.gitlab-ci.yml /.gitlab-ci/*"),
    ("ci_config", "forgejo_gitea_ci_config", "/.forgejo/workflows/* /.gitea/workflows/*"),
    ("ci_config", "appveyor_ci_config", "/appveyor.yml /.appveyor.yml"),
    ("ci_config", "azure_pipelines_config", "/azure-pipelines.yml /.azure-pipelines.yml"),
    ("ci_config", "circleci_config", "/.circleci/config.yml"),
    ("ci_config", "travis_ci_config", "/.travis.yml"),
    ("ci_config", "cloudbuild_config", "/cloudbuild.yaml /cloudbuild.yml"),
    ("ci_config", "bitbucket_pipelines_config", "/bitbucket-pipelines.yml"),
    ("dockerfile", "dockerfile", "dockerfile dockerfile.*"),
    ("dockerfile", "docker_compose", "docker-compose.yml docker-compose.yaml compose.yml compose.yaml"),
    ("dockerfile", "docker_ignore", "/.dockerignore"),
    ("lockfile", "lockfile", "cargo.lock package-lock.json yarn.lock pnpm-lock.yaml poetry.lock pnpm-lock.yml bun.lockb /composer.lock /go.sum /mix.lock /shrinkwrap.json"),
    ("manifest", "rust_manifest", "cargo.toml"),
    ("manifest", "nodejs_manifest", "package.json"),
    ("manifest", "python_manifest", "pyproject.toml setup.py setup.cfg"),
    ("manifest", "go_manifest", "go.mod"),
    ("manifest", "ruby_manifest", "gemspec *.gemspec gemfile"),
    ("manifest", "elixir_manifest", "mix.exs"),
    ("manifest", "php_manifest", "composer.json"),
    ("manifest", "jvm_manifest", "build.gradle build.gradle.kts pom.xml"),
    ("manifest", "dart_manifest", "pubspec.yaml"),
    ("manifest", "elm_manifest", "elm.json"),
    ("manifest", "python_requirements", "requirements.txt requirements.in"),
    ("manifest", "python_pipenv", "pipfile"),
    ("editor_config", "editor_config", ".editorconfig"),
    ("editor_config", "vscode_config", "/.vscode/*"),
    ("editor_config", "jetbrains_config", "/.idea/*"),
    ("git_ignore", "gitignore", ".gitignore .gitignore_global"),
    ("git_ignore", "git_attributes", ".gitattributes"),
    ("build_script", "makefile", "makefile gnumakefile"),
    ("build_script", "justfile", "justfile justfile.lock"),
    ("build_script", "cmake_build", "cmakelists.txt"),
    ("build_script", "build_script", "/build.rs /build.zig /build.zig.zon"),
    ("documentation", "documentation_directory", "docs /docs/*"),
    ("documentation", "mdbook_config", "book.toml"),
]
# Kinds of folders by their whole path.
FOLDERS = [
    ("source_root", "well_known_source_directory", "src lib crates packages apps cmd internal pkg"),
    ("examples", "examples_directory", "examples samples demo demos"),
    ("tests", "test_directory", "tests test spec specs benches benchmarks __tests__"),
    ("docs", "documentation_directory", "docs doc website book content wiki"),
    ("ci_config", "github_actions_directory", ".github/workflows .github/actions"),
    ("ci_config", "github_config_directory", ".github"),
    ("ci_config", "gitlab_ci_directory", ".gitlab-ci .gitlab"),
    ("ci_config", "forgejo_gitea_ci_directory", ".forgejo .gitea"),
    ("security", "security_directory", "security vulnerabilities advisories"),
    ("config", "config_directory", ".config config conf cfg"),
    ("generated", "generated_directory", "target node_modules vendor __pycache__ .next .nuxt dist build out .gradle .m2"),
    ("migrations", "migration_directory", "migrations migrate db/migrate alembic database/migrate prisma/migrations"),
]
# Bounds of a request.
MOST_DOMAINS, MOST_EXCERPTS, LOCALE = 32, 3, r"^(?=.{2,32}$)[A-Za-z](?:[A-Za-z0-9_-]*[A-Za-z0-9])?$"


def _fits(path: Column, names: str) -> Column:
    pattern = "|".join(("^" if n[0] == "/" else "(?:^|/)") + n.lstrip("/").replace(".", r"\.").replace("*", "[^/]*" if n[0] != "/" else ".*") + "$" for n in names.split())
    return F.lower(path).rlike(pattern)


def important_file(path: Column) -> Column:
    """struct(kind, reason) of a path; unknown without a reason for any other file."""
    out = F
    for kind, reason, names in FILES:
        out = out.when(_fits(path, names), F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason")))
    return out.otherwise(F.struct(F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("reason")))


def important_folder(path: Column) -> Column:
    out = F
    for kind, reason, names in FOLDERS:
        out = out.when(F.lower(path).isin(names.split()), F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason")))
    return out.otherwise(F.struct(F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("reason")))


def faults(query: Column, results: Column, start: Column, end: Column, fresh: Column, include: Column, exclude: Column, language: Column, excerpts: Column, most: int = 512) -> Column:
    """What is wrong with a search request, the first fault first; empty for a request that is served.

    include and exclude are arrays of domains; start and end are calendar dates, fresh a window."""
    day = lambda d: F.try_to_timestamp(F.when(F.trim(d).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.trim(d)))
    ranged = start.isNotNull() & end.isNotNull()
    clean = lambda ds: F.transform(F.coalesce(ds, F.array().cast("array<string>")), queries.domain)
    wrong = lambda ds: F.exists(clean(ds), lambda d: d.isNull())
    tests = [
        ("query_empty", F.trim(F.coalesce(query, F.lit(""))) == ""),
        ("query_too_long", F.length(query) > most),
        ("no_results_asked", results == 0),
        ("date_invalid", ranged & (day(start).isNull() | day(end).isNull())),
        ("dates_reversed", ranged & (day(start) > day(end))),
        ("dates_and_freshness", ranged & F.coalesce(fresh != "any", F.lit(False))),
        ("too_many_domains", F.greatest(F.size(F.coalesce(include, F.array().cast("array<string>"))), F.size(F.coalesce(exclude, F.array().cast("array<string>")))) > MOST_DOMAINS),
        ("domain_invalid", wrong(include) | wrong(exclude)),
        ("domain_in_both", F.arrays_overlap(clean(include), clean(exclude))),
        ("language_invalid", ~F.trim(language).rlike(LOCALE)),
        ("too_many_excerpts", excerpts > MOST_EXCERPTS),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests]))
