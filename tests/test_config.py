import json

from emberlens.operators import static_config as op

FILES = {
    "k8s/app.yaml": "kind: Deployment\nmetadata: {name: web}\nspec:\n  replicas: 3\n  template: {spec: {containers: [{name: a}, {name: b, resources: {limits: {cpu: 1}}}]}}\n---\nkind: Deployment\nmetadata: {name: api}\nspec: {replicas: 2, template: {spec: {containers: []}}}\n---\nkind: HorizontalPodAutoscaler\nmetadata: {name: h}\nspec: {scaleTargetRef: {kind: Deployment, name: api}}\n",
    "infra/template.json": json.dumps({"Resources": {"Data": {"Type": "AWS::S3::Bucket", "Properties": {}}, "Jobs": {"Type": "AWS::SQS::Queue"}, "Mail": {"Type": "AWS::SNS::Topic"}, "Use": {"Type": "AWS::IAM::Policy", "Properties": {"Queue": {"Ref": "Jobs"}}}, "Box": {"Type": "AWS::EC2::Instance", "Properties": {"InstanceType": "t2.micro"}}}}),
    ".github/workflows/ci.yml": "on:\n  pull_request:\njobs:\n  test:\n    runs-on: ubuntu-latest\n    strategy: {matrix: {py: ['3.12', '3.12']}}\n    steps:\n      - run: pip install -r requirements.txt\n      - uses: actions/cache/restore@v4\n        with: {key: fixed}\n      - run: make clean all\n      - uses: actions/upload-artifact@v4\n        with: {retention-days: 90}\n  image:\n    runs-on: ubuntu-latest\n    steps: [{run: 'npm ci'}, {run: 'docker build .'}]\n",
    "otel/collector.yaml": "exporters: {otlp: {compression: none}}\nservice: {pipelines: {traces: {processors: [memory_limiter]}, logs: {processors: [batch]}}}\nlog_level: DEBUG\nsampling_percentage: 100\n",
    "dev/settings.yaml": "log_level: DEBUG\n",
    "bad.yaml": "a: [1",
    "Dockerfile": "FROM python:3.13 AS build\nRUN apt-get update && \\\n  apt-get install -y gcc\nFROM python:3.13-slim\nCOPY --from=build /x /x\nRUN pip install flask\n",
}


def test_config_rules(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, text string")
    table = op.facts(files).cache()
    found = {(r.check_id, r.file.split("/")[-1], r.scope, r.identity) for r in op.hits(table).collect()}
    assert {
        ("INF-02", "app.yaml", "default/Deployment/web", "fixed-replicas"), ("INF-08", "app.yaml", "k8s/app.yaml", "container:a"), ("INF-10", "template.json", "resource:Data", "LifecycleConfiguration"),
        ("INF-04", "template.json", "resource:Mail", "unreferenced"), ("INF-07", "template.json", "infra/template.json", "/Resources/Box/Properties/InstanceType"),
        ("CI-06", "ci.yml", ".github/workflows/ci.yml", "job:image"), ("CI-07", "ci.yml", ".github/workflows/ci.yml", "job:image"), ("CI-08", "ci.yml", ".github/workflows/ci.yml", "job:test"),
        ("CI-11", "ci.yml", ".github/workflows/ci.yml", "no-cancellation"), ("CI-13", "ci.yml", ".github/workflows/ci.yml", "/jobs/test/strategy/matrix/py"), ("CI-16", "ci.yml", ".github/workflows/ci.yml", "test"),
        ("CI-19", "ci.yml", ".github/workflows/ci.yml", "job:test"), ("OBS-01", "collector.yaml", "otel/collector.yaml", "/log_level"), ("OBS-05", "collector.yaml", "otel/collector.yaml", "/sampling_percentage"),
        ("OBS-09", "collector.yaml", "otel/collector.yaml", "/exporters/otlp"), ("OBS-09", "collector.yaml", "otel/collector.yaml", "/service/pipelines/traces"),
    } == found
    assert {r.file: r.status for r in op.coverage(table).collect() if r.status == "omitted"} == {"bad.yaml": "omitted"}
    image = {r.identity for r in op.image_bloat(op.dockerfiles(files)).collect()}
    assert image == {"pip cache kept"}
