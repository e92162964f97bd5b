"""Dependencies that manifests declare, workspaces, and services of compose files."""

from __future__ import annotations

import json
import re
import tomllib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)")
MOST_BYTES = 512 * 1024


def _python(text: str) -> list[str]:
    if "[" in text and re.search(r"(?m)^\s*\[", text):
        data = tomllib.loads(text)
        project = data.get("project", {})
        found = list(project.get("dependencies", [])) + [d for ds in project.get("optional-dependencies", {}).values() for d in ds]
        names = [m[1] for m in map(_REQUIREMENT.match, found) if m]
        return names + [n for n in data.get("tool", {}).get("poetry", {}).get("dependencies", {}) if n != "python"]
    return [m[1] for m in (_REQUIREMENT.match(x) for x in text.splitlines() if not x.lstrip().startswith(("#", "-"))) if m]


def _npm(text: str) -> list[str]:
    data = json.loads(text)
    return [n for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for n in data.get(k, {})]


def _go(text: str) -> list[str]:
    blocks = "\n".join(re.findall(r"(?ms)^require\s*\((.*?)^\)", text)) + "\n" + "\n".join(re.findall(r"(?m)^require\s+([^(\n]+)$", text))
    return re.findall(r"(?m)^\s*([\w.~-]+(?:/[\w.~-]+)*)\s+v", blocks)


def _cargo(text: str) -> list[str]:
    data = tomllib.loads(text)
    tables = [data, data.get("workspace", {}), *data.get("target", {}).values()]
    return [n for t in tables for k in ("dependencies", "dev-dependencies", "build-dependencies") for n in t.get(k, {})]


def _maven(text: str) -> list[str]:
    tree = ElementTree.fromstring(text)
    plain = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    for dep in (e for e in tree.iter() if plain(e) == "dependency"):
        part = {plain(c): (c.text or "").strip() for c in dep}
        out.append(f"{part.get('groupId', '')}:{part.get('artifactId', '')}")
    return out


def _nuget(text: str) -> list[str]:
    tree = ElementTree.fromstring(text)
    return [e.attrib["Include"] for e in tree.iter() if e.tag.rsplit("}", 1)[-1] in ("PackageReference", "PackageVersion") and "Include" in e.attrib]


def _gradle(text: str) -> list[str]:
    return re.findall(r"(?m)^\s*(?:\w*[iI]mplementation|api|compileOnly|runtimeOnly|kapt)\s*\(?\s*['\"]([\w.-]+:[\w.-]+)", text)


READERS = {"manifest-python": _python, "manifest-npm": _npm, "manifest-go": _go, "manifest-cargo": _cargo, "manifest-maven": _maven, "manifest-nuget": _nuget, "manifest-gradle": _gradle}


def dependencies(files: DataFrame) -> DataFrame:
    """``path``, ``name``, ``error`` of what manifests (path, config_kind, text)
    declare; one that can't be read costs itself and says why."""

    def run(batches):
        for batch in batches:
            out = []
            for path, kind, text in zip(batch["path"], batch["config_kind"], batch["text"], strict=True):
                try:
                    out += [(path, n, None) for n in dict.fromkeys(READERS[kind](text))]
                except Exception as e:  # any malformed manifest
                    out.append((path, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "name", "error"])

    return files.filter(F.col("config_kind").isin(*READERS)).select("path", "config_kind", "text").mapInPandas(run, "path string, name string, error string")


def members(patterns: DataFrame, directories: DataFrame) -> DataFrame:
    """Directories that a workspace's patterns (``root``, ``pattern``) name: ``*`` is
    one segment, ``**`` any number. Directories meet patterns by the fixed directory
    that these begin with, one of their own prefixes: an equi join."""
    whole = F.concat_ws("/", F.when(F.col("root") != "", F.col("root")), "pattern")
    safe = F.regexp_replace(whole, r"([.+()\[\]{}^$|])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(safe, r"\*\*", "\u0001"), r"\*", "[^/]*"), "\u0001", ".*"), F.lit("$"))
    fixed = F.regexp_replace(F.substring_index(whole, "*", 1), "/?[^/]*$", "")
    fixed = F.when(F.instr(whole, "*") > 0, fixed).otherwise(whole)
    listed = patterns.select("root", "pattern", regex.alias("regex"), fixed.alias("fixed"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    under = directories.select("dir", F.explode(F.array_distinct(above)).alias("above"))
    return under.join(listed, (F.col("above") == F.col("fixed")) & F.expr("dir rlike regex")).select("root", "pattern", "dir")


#: Images that are stores and queues, by the name's beginning.
STORES = ("postgres", "mysql", "mariadb", "mongo", "redis", "memcached", "elasticsearch", "opensearch", "cassandra", "neo4j", "minio", "clickhouse", "influxdb", "cockroach")
QUEUES = ("rabbitmq", "kafka", "nats", "pulsar", "activemq", "zookeeper", "redpanda", "mosquitto")


def kind_of_image(image: str) -> str:
    name = image.rsplit("/", 1)[-1].split(":", 1)[0].lower()
    return "datastore" if name.startswith(STORES) else "queue" if name.startswith(QUEUES) else "service"


def compose(files: DataFrame) -> DataFrame:
    """Services of compose files: ``path``, ``service``, ``kind``, ``line``, ``context``
    and ``depends_on``; files over half a megabyte or without a YAML reader say so."""

    def one(path: str, text: str) -> list[tuple]:
        import yaml

        if len(text) > MOST_BYTES:
            return [(path, None, None, 0, None, [], "too-large")]
        root, out = yaml.compose(text, Loader=yaml.SafeLoader), []
        services = next((v for k, v in root.value if k.value == "services"), None) if isinstance(root, yaml.MappingNode) else None
        for key, body in services.value if isinstance(services, yaml.MappingNode) else []:
            part = {k.value: v for k, v in body.value} if isinstance(body, yaml.MappingNode) else {}
            image, build = part.get("image"), part.get("build")
            context = build.value if isinstance(build, yaml.ScalarNode) else next((v.value for k, v in build.value if k.value == "context"), None) if isinstance(build, yaml.MappingNode) else None
            needs = []
            for k in ("depends_on", "links"):
                v = part.get(k)
                needs += [i.value.split(":")[0] for i in v.value if isinstance(i, yaml.ScalarNode)] if isinstance(v, yaml.SequenceNode) else [i.value for i, _ in v.value] if isinstance(v, yaml.MappingNode) else []
            kind = kind_of_image(image.value) if isinstance(image, yaml.ScalarNode) and context is None else "service"
            out.append((path, key.value, kind, key.start_mark.line + 1, context, sorted(set(needs)), None))
        return out

    def run(batches):
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    out += one(path, text)
                except Exception as e:  # a missing reader, or malformed YAML
                    out.append((path, None, None, 0, None, [], type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "service", "kind", "line", "context", "depends_on", "error"])

    schema = "path string, service string, kind string, line int, context string, depends_on array<string>, error string"
    return files.filter(F.col("config_kind") == "compose").select("path", "text").mapInPandas(run, schema)
