"""What is deployed: services with the code that their images hold, and how it is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.operators.derive import View
from evgraph.operators.joins import prefixes
from evgraph.operators.resolve import normal_path
from evgraph.schema import module_of, path_of

#: Kinds of boxes for deployed things that build no code.
BOXES = {"datastore": "database", "queue": "messagebus", "service": "service"}


def build_contexts(services: DataFrame) -> DataFrame:
    """``id``, ``context`` of services (``id``, ``build_context``): the directory that a
    service builds, from its compose file's own; "" is the root. None where nothing is
    built or the path leaves the repository."""
    raw = F.replace("build_context", F.lit("\\"), F.lit("/"))
    found = services.filter(F.coalesce(F.col("build_context"), F.lit("")) != "")
    inside = normal_path(F.concat(module_of(path_of(F.col("id"))), F.lit("/"), raw))
    return found.filter(~raw.startswith("/")).select("id", inside.alias("context")).filter("context is not null")


def modules_under(contexts: DataFrame, modules: DataFrame) -> DataFrame:
    """``id``, ``module`` of the modules inside each context: every module meets the
    contexts among its own prefixes, so no pair is compared that does not match."""
    above = F.array_union(prefixes(F.col("module")), F.array(F.lit("")))
    spread = modules.select("module", F.explode(above).alias("above")).distinct()
    return spread.join(contexts, F.col("above") == F.col("context")).select("id", "module").distinct()


def ships(files: DataFrame) -> DataFrame:
    """``path``, ``line``, ``source`` of what Dockerfiles (path, text) copy in from where
    they are built; copies from other stages are left out."""
    docker = files.filter(F.substring_index("path", "/", -1).rlike(r"(?i)^(.*\.)?dockerfile(\..*)?$"))
    lines = docker.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    copies = lines.filter(F.col("line").rlike(r"(?i)^\s*(copy|add)\s") & ~F.col("line").rlike(r"(?i)\s--from="))
    bare = F.regexp_replace(F.regexp_replace("line", r"(?i)^\s*(copy|add)\s+", ""), r"--\S+\s+|[\[\]\",]", " ")
    words = F.filter(F.split(F.trim(bare), r"\s+"), lambda w: w != "")
    return copies.select("path", (F.col("n") + 1).alias("line"), F.explode(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).alias("source"))


def modules_shipped(contexts: DataFrame, modules: DataFrame, copied: DataFrame, files: DataFrame) -> DataFrame:
    """``id``, ``module``, ``line``: the modules a service's image holds, with the line that
    copies each; of services without ``copied`` rows (``id``, ``source``, ``line``) all that
    lie under the context. A copied file of ``files`` (path) stands for its module."""
    base = contexts.join(copied.withColumnRenamed("id", "c_id"), F.col("id") == F.col("c_id"))
    root = F.when(F.col("context") == "", F.lit(".")).otherwise(F.col("context"))
    at = base.select("id", "line", normal_path(F.concat(root, F.lit("/"), "source")).alias("context")).filter("context is not null")
    line = at.select(F.col("id").alias("l_id"), F.col("context").alias("l_at"), "line")
    named = at.select("id", "context", "line").distinct()
    above = F.array_union(prefixes(F.col("module")), F.array(F.lit("")))
    spread = modules.select("module", F.explode(above).alias("above")).distinct()
    inside = spread.join(named, F.col("above") == F.col("context")).select("id", "module", "line")
    single = line.join(files.select("path"), F.col("l_at") == F.col("path")).select(F.col("l_id").alias("id"), module_of(F.col("path")).alias("module"), "line")
    single = single.join(modules.select(F.col("module").alias("m")).distinct(), F.col("module") == F.col("m"), "left_semi")
    told = copied.select(F.col("id").alias("t")).distinct()
    rest = modules_under(contexts.join(told, F.col("id") == F.col("t"), "left_anti"), modules).withColumn("line", F.lit(None).cast("int"))
    return inside.unionByName(single).unionByName(rest).groupBy("id", "module").agg(F.min("line").alias("line"))


def system(nodes: DataFrame, edges: DataFrame, shipped: DataFrame, roles: DataFrame, routes: DataFrame, deps: DataFrame) -> View:
    """One box per deployed thing (``nodes``: id, kind, label), one arrow per declared
    dependency (``edges``: src, dst), and ``code`` arrows where the modules that one
    service ships depend on modules that only another does.

    Labels that several boxes share get their file's directory. A service that ships
    code is a frontend, security or backend box by its ``roles`` (module, role), with
    the number of ``routes`` (path) of its modules.
    """
    known = nodes.filter(F.col("kind").isin(*BOXES))
    same = known.groupBy(F.col("label").alias("s_label")).agg(F.count("*").alias("same"))
    where = module_of(path_of(F.col("id")))
    held = shipped.join(roles.select(F.col("module").alias("r_module"), "role"), F.col("module") == F.col("r_module"), "left")
    has = lambda *of: F.bool_or(F.coalesce(F.col("role").isin(*of), F.lit(False)))
    kinds = held.groupBy("id").agg(has("frontend").alias("front"), has("auth").alias("auth"), has("api", "worker").alias("back"))
    kind = F.when(F.col("front"), "frontend").when(F.col("auth") & ~F.col("back"), "security").otherwise("backend")
    kinds = kinds.select(F.col("id").alias("k_id"), kind.alias("built"))
    of = routes.select(module_of(F.col("path")).alias("r_module")).groupBy("r_module").agg(F.count("*").alias("n"))
    counts = shipped.join(of, F.col("module") == F.col("r_module")).groupBy(F.col("id").alias("c_id")).agg(F.sum("n").alias("routes"))
    plain = F.element_at(F.create_map(*[x for k, v in BOXES.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    boxes = known.join(same, F.col("label") == F.col("s_label")).join(kinds, F.col("id") == F.col("k_id"), "left").join(counts, F.col("id") == F.col("c_id"), "left")
    shown = F.when(F.col("same") > 1, F.concat("label", F.lit(" ("), F.when(where == "", ".").otherwise(where), F.lit(")"))).otherwise(F.col("label"))
    made = boxes.select("id", shown.alias("label"), F.coalesce("built", plain).alias("kind"), F.coalesce("routes", F.lit(0)).alias("routes"))
    ids = known.select(F.col("id").alias("n"))
    declared = edges.select("src", "dst").distinct().join(ids, F.col("src") == F.col("n"), "left_semi").join(ids, F.col("dst") == F.col("n"), "left_semi")
    a, b = (shipped.select(F.col("id").alias(f"{k}_id"), F.col("module").alias(f"{k}_module")) for k in "ab")
    across = deps.join(a, F.col("src") == F.col("a_module")).join(b, F.col("dst") == F.col("b_module")).filter("a_id <> b_id")
    own = shipped.select(F.col("id").alias("o_id"), F.col("module").alias("o_module"))
    foreign = across.join(own, (F.col("a_id") == F.col("o_id")) & (F.col("b_module") == F.col("o_module")), "left_anti")
    code = foreign.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst")).distinct()
    return View(made, declared.withColumn("kind", F.lit("declared")).unionByName(code.withColumn("kind", F.lit("code"))))


def environment_overlays(environments: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared environments (``name``, ``sources``) and the services in them (``name``,
    ``service``). ``environments``: name, source, file; ``services``: id, file, dockerfile.

    A file's name puts all services that the file defines into its environment, and an image's
    file those that are built from it; other declarations name no service. Both meet by
    equal file names; sources are as few as there are kinds of them.
    """
    facts = environments.select("name", "source", "file").distinct()
    badges = facts.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))
    here = services.select(F.col("id").alias("service"), F.col("file").alias("at"), F.lit("filename").alias("by"))
    made = services.filter("dockerfile is not null").select(F.col("id").alias("service"), F.col("dockerfile").alias("at"), F.lit("dockerfile").alias("by"))
    linked = facts.join(here.unionByName(made), (F.col("file") == F.col("at")) & (F.col("source") == F.col("by")))
    return badges, linked.select("name", "service").distinct()
