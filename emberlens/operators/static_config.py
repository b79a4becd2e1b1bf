"""Configuration files: YAML and JSON documents as (path, value) facts, Dockerfiles as instructions, and rules as relations.

Facts of a document: file, doc (its number in the file), path (keys and list places, joined by /), parent, key, value (text
of a scalar, null for a container), kind. Anti-joins over them express what is absent; files that do not parse stay in the
coverage as omitted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "file string, doc int, path string, parent string, key string, value string, kind string"
DOCKER_SCHEMA = "file string, line int, stage int, stage_name string, base string, instruction string, argument string"


def _parsers():
    """YAML with intrinsic tags read as plain values; None without the library."""
    try:
        import yaml
    except ImportError:
        return None

    class Loader(yaml.SafeLoader):
        pass

    def untagged(loader, _, node):
        if isinstance(node, yaml.ScalarNode):
            return loader.construct_scalar(node)
        return loader.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else loader.construct_mapping(node, deep=True)

    Loader.add_multi_constructor("!", untagged)
    # "on" stays a key, as workflows use it
    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:bool" or k in "tTfF"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    return lambda text: list(yaml.load_all(text, Loader))


def _walk(value: object, path: str, parent: str, key: str) -> Iterator[tuple]:
    if isinstance(value, dict):
        yield path, parent, key, None, "map"
        for k, v in value.items():
            yield from _walk(v, f"{path}/{k}", path, str(k))
    elif isinstance(value, list):
        yield path, parent, key, None, "list"
        for i, v in enumerate(value):
            yield from _walk(v, f"{path}/{i}", path, str(i))
    else:
        text = None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
        yield path, parent, key, text, "scalar"


def document_facts(file: str, text: str) -> list[tuple]:
    try:
        if file.endswith(".json"):
            docs = [json.loads(text)]
        else:
            parse = _parsers()
            if parse is None:
                return [(file, -1, "", "", "", "no YAML reader", "unparsed")]
            docs = parse(text)
    except Exception:  # any malformed document leaves its file unevaluated
        return [(file, -1, "", "", "", "does not parse", "unparsed")]
    return [(file, d, *row) for d, doc in enumerate(docs) if doc is not None for row in _walk(doc, "", "", "")] or [(file, 0, "", "", "", None, "map")]


def _rows(files: DataFrame, one, schema: str, types: list[pa.DataType]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = one(path or "", text or "")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, schema)


def facts(files: DataFrame) -> DataFrame:
    """Facts of YAML and JSON ``files`` (path, text)."""
    own = files.where(F.col("path").rlike("[.](ya?ml|json)$"))
    return _rows(own, document_facts, SCHEMA, [pa.string(), pa.int32(), *[pa.string()] * 5])


def docker_facts(file: str, text: str) -> list[tuple]:
    rows, stage, name, base = [], -1, "", ""
    joined = re.sub(r"\\[ \t]*\r?\n", lambda m: " \x00", text)  # continued lines keep their count
    line = 1
    for raw in joined.split("\n"):
        at, line = line, line + 1 + raw.count("\x00")
        m = re.match(r"\s*([A-Za-z]+)\s+(.*)", raw.replace("\x00", " "))
        if not m or raw.lstrip().startswith("#"):
            continue
        word, argument = m[1].upper(), m[2].strip()
        if word == "FROM":
            stage += 1
            parts = argument.split()
            base = next((p for p in parts if not p.startswith("--")), "")
            name = parts[-1].lower() if len(parts) > 2 and parts[-2].upper() == "AS" else str(stage)
        rows.append((file, at, stage, name, base, word, argument))
    return rows


def dockerfiles(files: DataFrame) -> DataFrame:
    own = files.where(F.col("path").rlike("(^|/)(Dockerfile[^/]*|[^/]*[.]dockerfile)$"))
    return _rows(own, docker_facts, DOCKER_SCHEMA, [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4])


def shipped_stages(table: DataFrame) -> DataFrame:
    """The last stage of each file and the stages that it builds on, by following FROM; others only lend files."""
    stages = table.where("instruction = 'FROM'").select("file", "stage", "stage_name", F.lower("base").alias("base"))
    level = stages.groupBy("file").agg(F.max("stage").alias("stage")).join(stages, ["file", "stage"]).select("file", "stage", "base")
    out = level
    while not level.isEmpty():
        up = stages.select("file", F.col("stage").alias("s"), "stage_name", F.col("base").alias("b"))
        level = level.join(up, "file").where((F.col("base") == F.col("stage_name")) & (F.col("s") < F.col("stage"))).select("file", F.col("s").alias("stage"), F.col("b").alias("base"))
        out = out.unionByName(level)
    return out.select("file", "stage").distinct()


def image_bloat(table: DataFrame) -> DataFrame:
    """INF-09: package caches and build tools that reach the shipped image."""
    own = table.join(shipped_stages(table), ["file", "stage"], "left_semi").where("instruction = 'RUN'")
    arg = F.col("argument")
    reasons = {
        "apt lists kept": arg.rlike("apt(-get)? .*install") & ~arg.contains("/var/lib/apt/lists"),
        "recommended packages": arg.rlike("apt-get .*install") & ~arg.contains("--no-install-recommends"),
        "pip cache kept": arg.rlike("pip3? install") & ~arg.contains("--no-cache-dir"),
        "apk cache kept": arg.rlike("apk add") & ~arg.contains("--no-cache"),
        "build tools": arg.rlike("(^| )(build-essential|gcc|g[+][+]|make)( |$)"),
    }
    found = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in reasons.items())), lambda x: x.isNotNull())
    return _hits(own.select("file", "line", F.explode(found).alias("reason")), "INF-09", F.col("file"), F.col("reason"))


def _hits(rows: DataFrame, check: str, scope: Column, identity: Column, confidence: str = "medium") -> DataFrame:
    return rows.select(F.lit(check).alias("check_id"), F.col("file"), scope.cast("string").alias("scope"), identity.alias("identity"), F.lit(confidence).alias("confidence"))


def _at(table: DataFrame, pattern: str, name: str) -> DataFrame:
    """file, doc and value of the scalars at paths that match."""
    return table.where(F.col("path").rlike(pattern)).select("file", "doc", F.col("path").alias(f"{name}_path"), F.col("value").alias(name))


def workloads(table: DataFrame) -> DataFrame:
    """Kubernetes objects: kind, name and namespace of each document."""
    kind, name, space = (_at(table, p, c).select("file", "doc", c) for p, c in (("^/kind$", "kind"), ("^/metadata/name$", "name"), ("^/metadata/namespace$", "namespace")))
    return kind.join(name, ["file", "doc"]).join(space, ["file", "doc"], "left").withColumn("namespace", F.coalesce("namespace", F.lit("default")))


def fixed_replicas(table: DataFrame, least: int = 2) -> DataFrame:
    """INF-02: literal replicas that no autoscaler targets by kind, name and namespace."""
    own = workloads(table)
    replicas = _at(table, "^/spec/replicas$", "replicas").select("file", "doc", F.try_to_number("replicas", F.lit("99999")).cast("int").alias("replicas"))
    scaled = own.where("kind IN ('Deployment', 'StatefulSet', 'ReplicaSet')").join(replicas, ["file", "doc"]).where(F.col("replicas") >= least)
    scalers = own.where("kind IN ('HorizontalPodAutoscaler', 'ScaledObject')").select("file", "doc", "namespace")
    target = _at(table, "^/spec/scaleTargetRef/name$", "target").select("file", "doc", "target")
    target_kind = _at(table, "^/spec/scaleTargetRef/kind$", "target_kind").select("file", "doc", "target_kind")
    aims = scalers.join(target, ["file", "doc"]).join(target_kind, ["file", "doc"], "left").select("namespace", F.col("target").alias("name"), F.coalesce("target_kind", F.lit("Deployment")).alias("kind"))
    left = scaled.join(aims, ["kind", "name", "namespace"], "left_anti")
    return left.select(F.lit("INF-02").alias("check_id"), "file", F.concat_ws("/", "namespace", "kind", "name").alias("scope"), F.lit("fixed-replicas").alias("identity"), F.when(F.col("kind") == "StatefulSet", "low").otherwise("medium").alias("confidence"))


def unbounded_containers(table: DataFrame) -> DataFrame:
    """INF-08: containers without requests or limits, unless a LimitRange in the file gives defaults."""
    containers = table.where(F.col("path").rlike("/(containers|initContainers)/[0-9]+$") & (F.col("kind") == "map")).select("file", "doc", F.col("path").alias("container"))
    bounded = table.where(F.col("key").isin("requests", "limits") & F.col("path").rlike("/resources/(requests|limits)$")).select("file", "doc", F.regexp_replace("path", "/resources/(requests|limits)$", "").alias("container")).distinct()
    defaults = table.where("path = '/kind' AND value = 'LimitRange'").select("file").distinct()
    left = containers.join(bounded, ["file", "doc", "container"], "left_anti").join(defaults, "file", "left_anti")
    names = table.where("key = 'name'").select("file", "doc", F.col("parent").alias("container"), F.col("value").alias("name"))
    return _hits(left.join(names, ["file", "doc", "container"], "left"), "INF-08", F.col("file"), F.concat_ws(":", F.lit("container"), F.coalesce("name", "container")))


def unmanaged_storage(table: DataFrame) -> DataFrame:
    """INF-10: buckets without a lifecycle, log groups without retention, repositories without a policy, in CloudFormation."""
    needs = {"AWS::S3::Bucket": "LifecycleConfiguration", "AWS::Logs::LogGroup": "RetentionInDays", "AWS::ECR::Repository": "LifecyclePolicy"}
    resources = table.where(F.col("path").rlike("^/Resources/[^/]+/Type$")).select("file", "doc", F.col("parent").alias("resource"), F.col("value").alias("type"))
    wanted = F.create_map(*(F.lit(x) for kv in needs.items() for x in kv))
    own = resources.where(F.col("type").isin(*needs)).withColumn("need", F.element_at(wanted, F.col("type")))
    have = table.where(F.col("path").rlike("^/Resources/[^/]+/Properties/[^/]+$")).select("file", "doc", F.regexp_extract("path", "^(/Resources/[^/]+)/", 1).alias("resource"), F.col("key").alias("need"))
    left = own.join(have, ["file", "doc", "resource", "need"], "left_anti")
    return _hits(left, "INF-10", F.regexp_replace("resource", "^/Resources/", "resource:"), F.col("need"))


def unreferenced(table: DataFrame) -> DataFrame:
    """INF-04: functions, queues and topics that nothing in any template refers to."""
    kinds = ("AWS::Lambda::Function", "AWS::Serverless::Function", "AWS::SQS::Queue", "AWS::SNS::Topic")
    own = table.where(F.col("path").rlike("^/Resources/[^/]+/Type$") & F.col("value").isin(*kinds)).select("file", F.regexp_extract("path", "^/Resources/([^/]+)/", 1).alias("name"))
    # an event source makes its function used; a reference is any scalar outside the resource that names it
    triggered = table.where(F.col("path").rlike("^/Resources/[^/]+/Properties/Events/")).select("file", F.regexp_extract("path", "^/Resources/([^/]+)/", 1).alias("name")).distinct()
    values = table.where("kind = 'scalar' AND value IS NOT NULL").select("file", F.regexp_extract("path", "^/Resources/([^/]+)/", 1).alias("owner"), F.explode(F.regexp_extract_all("value", F.lit("([A-Za-z0-9]+)"), F.lit(1))).alias("name"))
    used = values.where("owner <> name").select("file", "name").distinct()
    left = own.join(used, ["file", "name"], "left_anti").join(triggered, ["file", "name"], "left_anti")
    return _hits(left, "INF-04", F.concat(F.lit("resource:"), F.col("name")), F.lit("unreferenced"))


WORKFLOW = "(^|/)[.]github/workflows/[^/]+[.]ya?ml$"
INSTALLS = "(npm (ci|install)|yarn install|pnpm install|pip3? install|poetry install|bundle install|go mod download|cargo build|mvn |gradle )"


def steps(table: DataFrame) -> DataFrame:
    """Workflow steps in order: file, job, n, uses, run."""
    own = table.where(F.col("file").rlike(WORKFLOW) & F.col("path").rlike("^/jobs/[^/]+/steps/[0-9]+/(uses|run)$"))
    parts = own.select("file", F.regexp_extract("path", "^/jobs/([^/]+)/", 1).alias("job"), F.regexp_extract("path", "/steps/([0-9]+)/", 1).cast("int").alias("n"), "key", "value")
    return parts.groupBy("file", "job", "n").agg(F.max(F.when(F.col("key") == "uses", F.col("value"))).alias("uses"), F.max(F.when(F.col("key") == "run", F.col("value"))).alias("run"))


def uncached_installs(table: DataFrame) -> DataFrame:
    """CI-06: jobs that install dependencies without any cache."""
    own = steps(table)
    cached = own.where(F.col("uses").rlike("^(actions/cache|Swatinem/rust-cache|gradle/)")).select("file", "job")
    with_cache = table.where(F.col("path").rlike("^/jobs/[^/]+/steps/[0-9]+/with/(cache|bundler-cache|enable-cache)$") & (F.coalesce("value", F.lit("")) != "false")).select("file", F.regexp_extract("path", "^/jobs/([^/]+)/", 1).alias("job"))
    left = own.where(F.col("run").rlike(INSTALLS)).select("file", "job").distinct().join(cached.unionByName(with_cache).distinct(), ["file", "job"], "left_anti")
    return _hits(left, "CI-06", F.col("file"), F.concat(F.lit("job:"), F.col("job")))


def uncached_images(table: DataFrame) -> DataFrame:
    """CI-07: image builds without a layer cache."""
    own = steps(table)
    builds = own.where(F.col("uses").startswith("docker/build-push-action") | F.col("run").rlike("docker (buildx )?build"))
    cached = table.where(F.col("path").rlike("^/jobs/[^/]+/steps/[0-9]+/with/cache-(from|to)$")).select("file", F.regexp_extract("path", "^/jobs/([^/]+)/", 1).alias("job"), F.regexp_extract("path", "/steps/([0-9]+)/", 1).cast("int").alias("n"))
    left = builds.where(~F.coalesce(F.col("run").contains("--cache-from"), F.lit(False))).join(cached, ["file", "job", "n"], "left_anti")
    return _hits(left.select("file", "job").distinct(), "CI-07", F.col("file"), F.concat(F.lit("job:"), F.col("job")))


def cleans_after_restore(table: DataFrame) -> DataFrame:
    """CI-08: a clean build after a cache was restored in the same job."""
    own = steps(table)
    restored = own.where(F.col("uses").startswith("actions/cache")).groupBy("file", "job").agg(F.min("n").alias("restored"))
    left = own.where(F.col("run").rlike("(mvn|gradle|gradlew|make|cargo) ([a-z-]+ )*clean|rm -rf (target|build|node_modules)")).join(restored, ["file", "job"]).where("n > restored")
    return _hits(left.select("file", "job").distinct(), "CI-08", F.col("file"), F.concat(F.lit("job:"), F.col("job")), "high")


def no_cancellation(table: DataFrame) -> DataFrame:
    """CI-11: workflows for pull requests without a concurrency group that cancels."""
    own = table.where(F.col("file").rlike(WORKFLOW))
    pulls = own.where("(parent = '/on' AND (key = 'pull_request' OR value = 'pull_request')) OR (path = '/on' AND value = 'pull_request')").select("file").distinct()
    cancels = own.where(F.col("path").rlike("^(/jobs/[^/]+)?/concurrency/cancel-in-progress$") & (F.coalesce("value", F.lit("")) != "false")).select("file").distinct()
    return _hits(pulls.join(cancels, "file", "left_anti"), "CI-11", F.col("file"), F.lit("no-cancellation"))


def duplicate_axes(table: DataFrame) -> DataFrame:
    """CI-13: a value twice on one axis of a job's matrix."""
    cells = table.where(F.col("file").rlike(WORKFLOW) & F.col("path").rlike("^/jobs/[^/]+/strategy/matrix/[^/]+/[0-9]+$") & (F.col("kind") == "scalar"))
    left = cells.groupBy("file", F.col("parent").alias("axis")).agg(F.count("*").alias("n"), F.countDistinct("value").alias("d")).where("n > d")
    return _hits(left, "CI-13", F.col("file"), F.col("axis"), "high")


def large_runners(table: DataFrame, cores: int = 8) -> DataFrame:
    """CI-14: runners of many cores in jobs that only lint or label."""
    jobs = table.where(F.col("file").rlike(WORKFLOW) & F.col("path").rlike("^/jobs/[^/]+/runs-on$")).select("file", F.regexp_extract("path", "^/jobs/([^/]+)/", 1).alias("job"), F.regexp_extract("value", "([0-9]+)-?cores?", 1).alias("c"))
    light = jobs.where((F.col("c") != "") & (F.col("c").cast("int") >= cores) & F.col("job").rlike("(?i)lint|label|format|docs|stale"))
    return _hits(light, "CI-14", F.col("file"), F.concat(F.lit("job:"), F.col("job")))


def static_keys(table: DataFrame) -> DataFrame:
    """CI-16: cache keys that never change or ignore the system."""
    keys = table.where(F.col("file").rlike(WORKFLOW) & F.col("path").rlike("/steps/[0-9]+/with/key$")).select("file", "path", "value")
    left = keys.where(~F.col("value").contains("hashFiles") & ~F.col("value").contains("github.sha") | ~F.col("value").contains("runner.os"))
    return _hits(left, "CI-16", F.col("file"), F.regexp_extract("path", "^/jobs/([^/]+)/", 1))


def long_retention(table: DataFrame, most: int = 30) -> DataFrame:
    """CI-19: artifacts kept for long, one finding for each job."""
    kept = table.where(F.col("file").rlike(WORKFLOW) & F.col("path").rlike("/steps/[0-9]+/with/retention-days$")).where(F.col("value").rlike("^[0-9]{1,6}$") & (F.col("value").cast("int") > most))
    first = kept.select("file", F.regexp_extract("path", "^/jobs/([^/]+)/", 1).alias("job")).distinct()
    return _hits(first, "CI-19", F.col("file"), F.concat(F.lit("job:"), F.col("job")), "high")


NON_PRODUCTION = "(?i)(^|[/._-])(dev|development|local|test|tests|example|examples|sandbox|staging)([/._-]|$)"


def debug_levels(table: DataFrame) -> DataFrame:
    """OBS-01: DEBUG or TRACE as a log level outside of non-production files and keys."""
    own = table.where(F.lower("key").isin("log_level", "loglevel", "log-level", "level", "logging_level", "rust_log") & F.upper("value").isin("DEBUG", "TRACE"))
    return _hits(own.where(~F.col("file").rlike(NON_PRODUCTION) & ~F.col("path").rlike(NON_PRODUCTION)), "OBS-01", F.col("file"), F.col("path"), "high")


def full_sampling(table: DataFrame) -> DataFrame:
    """OBS-05: samplers that keep every trace."""
    all_ = F.col("key").isin("sampling_percentage", "samplingPercentage") & F.col("value").rlike("^100([.]0+)?$")
    always = F.lower("key").isin("otel_traces_sampler", "sampler") & F.lower("value").isin("always_on", "parentbased_always_on")
    ratio = F.lower("key").isin("otel_traces_sampler_arg", "tracessamplerate", "traces_sample_rate", "sampling_rate") & F.col("value").rlike("^1([.]0+)?$")
    return _hits(table.where((all_ | always | ratio) & ~F.col("file").rlike(NON_PRODUCTION)), "OBS-05", F.col("file"), F.col("path"))


def scrape_cost(table: DataFrame, least_seconds: int = 15, most_days: int = 15) -> DataFrame:
    """OBS-08: frequent scrapes that the same file's store keeps for long."""
    unit = lambda c, u: F.regexp_extract(c, f"^([0-9]+){u}$", 1)
    scrapes = table.where(F.col("key") == "scrape_interval").select("file", "path", F.nullif(unit("value", "s"), F.lit("")).cast("int").alias("s")).where(F.col("s") < least_seconds)
    kept = table.where(F.col("key").rlike("retention")).select("file", F.nullif(unit("value", "d"), F.lit("")).cast("int").alias("d")).groupBy("file").agg(F.max("d").alias("d")).where(F.col("d") > most_days)
    return _hits(scrapes.join(kept, "file"), "OBS-08", F.col("file"), F.col("path"))


def unbatched_exports(table: DataFrame) -> DataFrame:
    """OBS-09: collector pipelines without a batch processor, and exporters without compression."""
    pipes = table.where(F.col("path").rlike("^/service/pipelines/[^/]+$") & (F.col("kind") == "map")).select("file", F.col("path").alias("pipe"))
    batched = table.where(F.col("path").rlike("^/service/pipelines/[^/]+/processors/[0-9]+$") & F.col("value").rlike("^batch(/|$)")).select("file", F.regexp_extract("path", "^(/service/pipelines/[^/]+)/", 1).alias("pipe"))
    plain = table.where(F.col("path").rlike("^/exporters/[^/]+/compression$") & (F.col("value") == "none")).select("file", F.col("parent").alias("pipe"))
    return _hits(pipes.join(batched, ["file", "pipe"], "left_anti").unionByName(plain), "OBS-09", F.col("file"), F.col("pipe"))


def similar_sizes(table: DataFrame) -> DataFrame:
    """INF-06: one template whose api, event and schedule functions all have the same size."""
    events = table.where(F.col("path").rlike("^/Resources/[^/]+/Properties/Events/[^/]+/Type$")).select("file", F.regexp_extract("path", "^/Resources/([^/]+)/", 1).alias("name"), F.when(F.col("value").isin("Api", "HttpApi"), "api").when(F.col("value").isin("Schedule", "ScheduleV2"), "schedule").otherwise("event").alias("trigger"))
    size = table.where(F.col("path").rlike("^/Resources/[^/]+/Properties/(MemorySize|Timeout)$")).select("file", F.regexp_extract("path", "^/Resources/([^/]+)/", 1).alias("name"), F.concat_ws("=", "key", "value").alias("v"))
    sizes = size.groupBy("file", "name").agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias("size"))
    agg = events.join(sizes, ["file", "name"]).groupBy("file").agg(F.countDistinct("trigger").alias("triggers"), F.countDistinct("size").alias("sizes"), F.countDistinct("name").alias("n"))
    return _hits(agg.where("triggers = 3 AND sizes = 1"), "INF-06", F.col("file"), F.lit("same-size"))


# Instance families that newer ones replace.
OLD_FAMILIES = ("t1", "t2", "m1", "m2", "m3", "m4", "c1", "c3", "c4", "r3", "r4")


def old_instances(table: DataFrame) -> DataFrame:
    """INF-07: old instance families."""
    own = table.where(F.col("key").isin("InstanceType", "instance_type", "instanceType", "DBInstanceClass")).select("file", "path", F.regexp_extract("value", "^(?:db[.]|cache[.])?([a-z][0-9][a-z]*)[.]", 1).alias("family"))
    return _hits(own.where(F.col("family").isin(*OLD_FAMILIES)), "INF-07", F.col("file"), F.col("path"), "high")


TEST_RUNS = "(^|[ &;|])(pytest|npm (run )?test|yarn test|pnpm test|mvn (test|verify)|gradle test|go test|cargo test|tox)( |$)"
SELECTED = "--(changed|only-changed|onlyChanged|lf|last-failed|testmon|affected|since)|nx affected| -k "


def whole_tests(table: DataFrame) -> DataFrame:
    """CI-10: jobs that run all tests on every pull request, whatever paths it changes."""
    own = table.where(F.col("file").rlike(WORKFLOW))
    pulls = own.where("(parent = '/on' AND (key = 'pull_request' OR value = 'pull_request')) OR (path = '/on' AND value = 'pull_request')").select("file").distinct()
    chosen = own.where(F.col("path").rlike("^/on/pull_request/paths(-ignore)?$")).select("file").distinct()
    runs = steps(table).where(F.col("run").rlike(TEST_RUNS) & ~F.col("run").rlike(SELECTED)).select("file", "job").distinct()
    left = runs.join(pulls, "file", "left_semi").join(chosen, "file", "left_anti")
    return _hits(left, "CI-10", F.col("file"), F.concat(F.lit("job:"), F.col("job")))


def _containers(table: DataFrame) -> DataFrame:
    """file, doc and container of Kubernetes containers."""
    return table.where(F.col("path").rlike("/containers/[0-9]+$") & (F.col("kind") == "map")).select("file", "doc", F.col("path").alias("container"))


def _of_container(table: DataFrame, rest: str) -> DataFrame:
    """Scalars below containers, with the container."""
    at = F.regexp_extract("path", f"^(.*/containers/[0-9]+)/{rest}$", 1)
    return table.where("kind = 'scalar'").select("file", "doc", at.alias("container"), "key", "value").where("container <> ''")


def default_instrumentation(table: DataFrame) -> DataFrame:
    """OBS-12: containers under zero-code instrumentation that select no instrumentations."""
    words = _of_container(table, "(command|args)/[0-9]+").unionByName(_of_container(table, "env/[0-9]+/value"))
    auto = words.where(F.col("value").rlike("opentelemetry-instrument|-javaagent:.*opentelemetry|auto-instrumentations-node/register")).select("file", "doc", "container").distinct()
    chosen = _of_container(table, "env/[0-9]+/name").where(F.col("value").rlike("^OTEL_.*(DISABLED_INSTRUMENTATIONS|ENABLED_INSTRUMENTATIONS|INSTRUMENTATION_.*_ENABLED)$")).select("file", "doc", "container")
    return _hits(auto.join(chosen, ["file", "doc", "container"], "left_anti"), "OBS-12", F.col("file"), F.col("container"))


def traced_probes(table: DataFrame) -> DataFrame:
    """OBS-13: health probes of instrumented containers whose path no filter in any file names; the identity has the probes a day of the workload."""
    probe = table.where(F.col("path").rlike("/containers/[0-9]+/(livenessProbe|readinessProbe|startupProbe)/httpGet/path$"))
    probe = probe.select("file", "doc", F.regexp_extract("path", "^(.*/containers/[0-9]+)/", 1).alias("container"), F.regexp_extract("path", "/([a-z]+Probe)/", 1).alias("probe"), F.col("value").alias("target"))
    instrumented = _of_container(table, "env/[0-9]+/name").where(F.col("value").rlike("^OTEL_EXPORTER_OTLP")).select("file", "doc", "container").distinct()
    own = probe.join(instrumented, ["file", "doc", "container"])
    filters = table.where(F.col("path").rlike("^/processors/(filter|tail_sampling)(/|$)") & (F.col("kind") == "scalar") & F.col("value").isNotNull()).select(F.col("value").alias("filter"))
    every = filters.unionByName(table.where("key = 'value' AND value IS NOT NULL").where(F.col("path").rlike("/env/[0-9]+/value$")).select(F.col("value").alias("filter")))
    # paths that differ are few, and meet the filters once each
    named = own.select("target").distinct().join(every, F.col("filter").contains(F.col("target"))).select("target").distinct()
    left = own.join(named, "target", "left_anti")
    period = table.where(F.col("path").rlike("Probe/periodSeconds$")).select("file", "doc", F.regexp_extract("path", "^(.*/containers/[0-9]+)/", 1).alias("container"), F.regexp_extract("path", "/([a-z]+Probe)/", 1).alias("probe"), F.col("value").cast("int").alias("period"))
    replicas = table.where("path = '/spec/replicas'").select("file", "doc", F.col("value").cast("int").alias("replicas"))
    volume = F.coalesce("replicas", F.lit(1)) * F.floor(F.lit(86400) / F.coalesce("period", F.lit(10)))
    full = left.join(period, ["file", "doc", "container", "probe"], "left").join(replicas, ["file", "doc"], "left")
    return _hits(full, "OBS-13", F.col("file"), F.concat_ws(":", "probe", "target", volume.cast("string")))


# Hosts of paid telemetry services.
PAID = "datadoghq[.]com|honeycomb[.]io|nr-data[.]net|signalfx[.]com|grafana[.]net"


def paid_telemetry(table: DataFrame) -> DataFrame:
    """OBS-14: non-production telemetry that goes to a paid service and that nothing in the file reduces."""
    own = table.where(F.col("file").rlike(NON_PRODUCTION) & (F.col("kind") == "scalar") & F.col("value").rlike(PAID))
    reduced = table.where(F.col("path").rlike("^/processors/(filter|probabilistic_sampler|tail_sampling)(/|$)")).select("file").distinct()
    return _hits(own.join(reduced, "file", "left_anti"), "OBS-14", F.col("file"), F.col("path"))


def server_flags(table: DataFrame) -> DataFrame:
    """LLM-19: model servers started with flags that waste their accelerator."""
    words = table.where((F.col("kind") == "scalar") & F.col("path").rlike("/(args|command)(/[0-9]+)?$")).select("file", "doc", "parent", "value")
    serving = words.where(F.col("value").rlike("vllm|text-generation-launcher|api_server")).select("file", "doc").distinct()
    flag = F.regexp_extract("value", "(--enforce-eager|--no-enable-prefix-caching|--max-num-seqs[ =]1\\b|--max-batch-total-tokens[ =][0-9]{1,3}\\b)", 1)
    left = words.join(serving, ["file", "doc"], "left_semi").select("file", flag.alias("flag")).where("flag <> ''").distinct()
    return _hits(left, "LLM-19", F.col("file"), F.col("flag"))


RULES = (fixed_replicas, unbounded_containers, unmanaged_storage, unreferenced, similar_sizes, old_instances, uncached_installs, uncached_images, cleans_after_restore, no_cancellation, duplicate_axes, large_runners, static_keys, long_retention, debug_levels, full_sampling, scrape_cost, unbatched_exports, whole_tests, default_instrumentation, traced_probes, paid_telemetry, server_flags)


def hits(table: DataFrame) -> DataFrame:
    """Every rule's hits; repeated identities of a scope get ordinals."""
    out = None
    for rule in RULES:
        part = rule(table)
        out = part if out is None else out.unionByName(part)
    n = F.row_number().over(Window.partitionBy("check_id", "file", "scope", "identity").orderBy("confidence"))
    return out.withColumn("identity", F.when(n > 1, F.concat("identity", F.lit("#"), n.cast("string"))).otherwise(F.col("identity")))


def coverage(table: DataFrame) -> DataFrame:
    bad = F.max(F.when(F.col("kind") == "unparsed", F.col("value")))
    return table.groupBy("file").agg(bad.alias("reason")).select("file", F.when(F.col("reason").isNull(), "evaluated").otherwise("omitted").alias("status"), "reason")
