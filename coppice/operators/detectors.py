"""Detectors over the relations of a code corpus, each giving accepted and declined findings.

Relations (columns that a detector does not name are free):

``clauses``   path, line, module, name, arity, body_hash, skeleton_hash, mass, public, n_clauses, lines, literals array
``calls``     path, line, module, caller, callee, pos, arg, literal, dynamic
``literals``  path, line, module, kind, value, context
``segments``  path, line, block, idx, callee, reads array, writes array, hash, mass, pure, depth
``branches``  path, line, site, branch, idx, hash
``elements``  the nodes relation with path
``lists``     path, line, items array (keyword lists, attribute orders)

What a rule needs is a relation, or a column beyond these (``clauses.kind``); without it the rule is left out.

Gates are evaluated in a stated order and the first that fails is the reason; ambiguity
declines. Groups meet by equality of hashes and names only; no two sites are compared
pair by pair.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions import segments as S
from coppice.operators import graphs
from coppice.operators import mining as M
from coppice.plans.engine import Rule, register
from coppice.plans.findings import findings, first_decline
from coppice.session import ship


def detector(name: str, *needs: str, priority: int = 100, enabled: bool = True):
    def add(f):
        register(Rule(name, detect=f, needs=needs, priority=priority, enabled=enabled))
        return f

    return add


# Clones of functions: one aggregate over a key, then gates over its counts.


def _clone_groups(clauses: DataFrame, key: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    winner = F.struct(F.size(F.split("module", r"\.")).alias("segments"), F.col("module"), F.col("name"), F.col("path"), F.col("line"))
    measures = {"n": F.count(F.lit(1)), "modules": F.countDistinct("module"), "names": F.countDistinct("name"), "bodies": F.countDistinct("body_hash"), "least_mass": F.min("mass"), "all_public": F.bool_and("public"), "any_public": F.bool_or("public"), "winner": F.max(winner)}
    return clauses.groupBy(*key).agg(*[c.alias(n) for n, c in (measures | (extra or {})).items()]).filter("n > 1")


def _clones(clauses: DataFrame, rule: str, kind: str, key: list[str], gates: list[tuple[Column, str]], extra: dict[str, Column] | None = None) -> DataFrame:
    groups = _clone_groups(clauses, key, extra)
    rows = groups.withColumns({"path": F.col("winner.path"), "line": F.col("winner.line"), "module": F.col("winner.module"), "function": F.col("winner.name")})
    evidence = {c: F.col(c) for c in ("n", "modules", "names", "bodies", "least_mass")}
    return findings(rows, rule, kind, first_decline(gates), evidence, module="module", function="function", arity="arity" if "arity" in key else None)


def _mass(options: dict, default: int) -> tuple[Column, str]:
    return F.col("least_mass") < options.get("min_mass", default), "too_small"


@detector("DelegateExactDuplicates", "clauses")
def delegate_exact_duplicates(r, o):
    return _clones(r["clauses"].filter("public"), "DelegateExactDuplicates", "exact_duplicate", ["name", "arity", "body_hash"], [_mass(o, 20), (F.col("modules") < 2, "one_module")])


@detector("ExtractSharedModule", "clauses")
def extract_shared_module(r, o):
    return _clones(r["clauses"], "ExtractSharedModule", "shared_clone", ["name", "arity", "body_hash"], [_mass(o, 20), (F.col("modules") < 2, "one_module")])


@detector("ExtractRenamedClone", "clauses")
def extract_renamed_clone(r, o):
    single = {"clauses_each": F.max("n_clauses")}
    gates = [_mass(o, 20), (~F.col("all_public"), "private"), (F.col("clauses_each") > 1, "several_clauses"), (F.col("names") < 2, "not_renamed")]
    return _clones(r["clauses"], "ExtractRenamedClone", "renamed_clone", ["arity", "body_hash"], gates, single)


@detector("ExtractParametricClone", "clauses", priority=110)
def extract_parametric_clone(r, o):
    literals = r["clauses"].select("arity", "skeleton_hash", F.posexplode("literals").alias("pos", "value"))
    holes = literals.groupBy("arity", "skeleton_hash", "pos").agg(F.countDistinct("value").alias("k")).filter("k > 1").groupBy("arity", "skeleton_hash").agg(F.count(F.lit(1)).alias("holes"))
    clauses = r["clauses"].join(holes, ["arity", "skeleton_hash"], "left").withColumn("holes", F.coalesce("holes", F.lit(0)))
    gates = [_mass(o, 25), (F.col("bodies") < 2, "exact"), (F.col("holes") > o.get("max_literals", 5), "too_many_literals")]
    return _clones(clauses, "ExtractParametricClone", "parametric_clone", ["arity", "skeleton_hash"], gates, {"holes": F.max("holes")})


@detector("ExtractIntraModuleClone", "clauses")
def extract_intra_module_clone(r, o):
    return _clones(r["clauses"], "ExtractIntraModuleClone", "intra_module_clone", ["module", "arity", "body_hash"], [_mass(o, 20)])


@detector("ExtractInlineBlock", "clauses.kind")
def extract_inline_block(r, o):
    return _clones(r["clauses"].filter("kind = 'block'"), "ExtractInlineBlock", "inline_block", ["module", "body_hash"], [_mass(o, 20)])


@detector("ExtractLambdaBlock", "clauses.kind")
def extract_lambda_block(r, o):
    return _clones(r["clauses"].filter("kind = 'lambda'"), "ExtractLambdaBlock", "lambda_block", ["module", "body_hash"], [_mass(o, 20)])


@detector("PromoteRepeatedPrivateHelpers", "clauses", enabled=False)
def promote_repeated_private_helpers(r, o):
    return _clones(r["clauses"].filter("not public"), "PromoteRepeatedPrivateHelpers", "private_helper", ["name", "arity", "body_hash"], [_mass(o, 20), (F.col("modules") < 2, "one_module")])


@detector("RepeatedPatternToMacro", "clauses", enabled=False)
def repeated_pattern_to_macro(r, o):
    return _clones(r["clauses"].filter("arity <= 1"), "RepeatedPatternToMacro", "repeated_pattern", ["module", "arity", "skeleton_hash"], [(F.col("n") < o.get("least", 3), "too_few")])


@detector("TableDriveSimilarTests", "clauses", enabled=False)
def table_drive_similar_tests(r, o):
    tests = r["clauses"].filter(F.col("name").startswith("test"))
    literals = tests.select("module", "skeleton_hash", F.posexplode("literals").alias("pos", "value")).groupBy("module", "skeleton_hash", "pos").agg(F.countDistinct("value").alias("k")).filter("k > 1").groupBy("module", "skeleton_hash").agg(F.count(F.lit(1)).alias("columns"))
    tests = tests.join(literals, ["module", "skeleton_hash"], "left").withColumn("columns", F.coalesce("columns", F.lit(0)))
    gates = [(F.col("n") < o.get("least", 3), "too_few"), (F.col("columns") > o.get("columns", 4), "too_many_columns")]
    return _clones(tests, "TableDriveSimilarTests", "similar_tests", ["module", "skeleton_hash"], gates, {"columns": F.max("columns")})


@detector("ConsolidateParallelClauseFunctions", "clauses")
def consolidate_parallel(r, o):
    one_apart = {"varying": F.size(F.array_distinct(F.flatten(F.collect_set("literals"))))}
    gates = [(F.col("bodies") < 2, "exact"), (F.col("varying") > o.get("captures", 2), "too_different")]
    return _clones(r["clauses"], "ConsolidateParallelClauseFunctions", "parallel_functions", ["module", "arity", "skeleton_hash"], gates, one_apart)


@detector("MergeClausesIntoCondOrGuard", "clauses.head", "clauses.guard")
def merge_clauses(r, o):
    same = r["clauses"].groupBy("path", "module", "name", "arity").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n"), F.countDistinct("head").alias("heads"), F.bool_or(F.col("guard") == "").alias("total"))
    gates = [(F.col("heads") > 1, "heads_differ"), (~F.col("total"), "no_fallback")]
    return findings(same.filter("n > 1"), "MergeClausesIntoCondOrGuard", "guard_clauses", first_decline(gates), {"n": F.col("n")}, module="module", function="name", arity="arity")


# Literals.


def _literals(r, rule: str, kind: str, wanted: Column, least: int, nameable: Column) -> DataFrame:
    rows = r["literals"].filter(wanted)
    places = rows.groupBy("module", "value").agg(F.min("path").alias("path"), F.min("line").alias("line"))
    groups = M.literal_groups(rows, ["module"], "value", "context", nameable, least).join(places, ["module", "value"])
    return findings(groups, rule, kind, F.col("decline"), {"value": F.col("value"), "n": F.col("n")}, module="module")


@detector("ExtractMagicNumber", "literals")
def extract_magic_number(r, o):
    return _literals(r, "ExtractMagicNumber", "magic_number", F.col("kind") == "number", o.get("least", 2), ~F.col("value").isin("0", "1", "-1", "2"))


@detector("ExtractStringLiteral", "literals", enabled=False)
def extract_string_literal(r, o):
    letters = F.length(F.regexp_replace("value", "[^A-Za-z ]", "")) / F.length("value")
    return _literals(r, "ExtractStringLiteral", "string_literal", (F.col("kind") == "string") & (F.length("value") >= o.get("min_length", 3)), o.get("least", 2), letters >= 0.8)


@detector("ExtractErrorVocabulary", "literals")
def extract_error_vocabulary(r, o):
    return _literals(r, "ExtractErrorVocabulary", "error_atom", F.col("kind") == "error", o.get("least", 3), F.lit(True))


@detector("HoistHardcodedConfig", "literals")
def hoist_hardcoded_config(r, o):
    rows = r["literals"].filter((F.col("kind") == "string") & F.col("value").rlike(r"^(https?://|/[A-Za-z0-9_.-]+/)"))
    return findings(rows, "HoistHardcodedConfig", "hardcoded_config", evidence={"value": F.col("value")}, module="module")


# Calls.


@detector("RemoveDeadPrivateFunction", "clauses", "calls")
def remove_dead_private_function(r, o):
    """Private functions that no public one reaches; a dynamic call reaches everything in its module."""
    name = lambda c: F.concat_ws("#", "module", c)
    nodes = r["clauses"].select(name("name").alias("node")).distinct()
    arcs = r["calls"].select(name("caller").alias("src"), name("callee").alias("dst"))
    dynamic = r["calls"].filter("dynamic").select(name("caller").alias("src"), "module").join(r["clauses"].select("module", name("name").alias("dst")), "module").select("src", "dst")
    alive = graphs.dead(nodes, r["clauses"].filter("public").select(name("name").alias("node")), arcs.unionByName(dynamic).distinct())
    rows = r["clauses"].withColumn("node", name("name")).join(alive, "node").groupBy("module", "name", "arity").agg(F.min("path").alias("path"), F.min("line").alias("line"))
    return findings(rows, "RemoveDeadPrivateFunction", "dead_function", module="module", function="name", arity="arity")


@detector("InlineSingleCallerPrivate", "clauses", "calls")
def inline_single_caller_private(r, o):
    uses = r["calls"].groupBy("module", F.col("callee").alias("name")).agg(F.count(F.lit(1)).alias("uses"), F.bool_or(F.col("caller") == F.col("callee")).alias("recursive"))
    rows = r["clauses"].filter("not public").join(uses, ["module", "name"]).filter("uses = 1")
    gates = [(F.col("recursive"), "recursive"), (F.col("n_clauses") > 1, "several_clauses"), (F.col("lines") > o.get("max_lines", 5), "too_long")]
    return findings(rows, "InlineSingleCallerPrivate", "single_caller", first_decline(gates), module="module", function="name", arity="arity")


@detector("PushParamIntoCallee", "calls")
def push_param_into_callee(r, o):
    rows = M.constant_arguments(r["calls"].filter("literal"), ["module", "callee", "pos"], "arg")
    mixed = r["calls"].filter("not literal").select("module", "callee", "pos").distinct().withColumn("mixed", F.lit(True))
    rows = rows.join(mixed, ["module", "callee", "pos"], "left")
    return findings(rows, "PushParamIntoCallee", "constant_argument", first_decline([(F.col("mixed"), "not_always_literal")]), {"argument": F.col("argument"), "calls": F.col("calls")}, module="module", function="callee")


@detector("SplitFlagArgument", "calls", enabled=False)
def split_flag_argument(r, o):
    groups = r["calls"].groupBy("module", "callee", "pos").agg(F.countDistinct("arg").alias("kinds"), F.bool_and("literal").alias("all_literal"), F.bool_and(F.col("arg").isin("true", "false")).alias("boolean")).filter("kinds >= 2")
    gates = [(~F.col("all_literal"), "not_always_literal"), (~F.col("boolean") & (F.col("kinds") > o.get("values", 4)), "too_many_values")]
    return findings(groups, "SplitFlagArgument", "flag_argument", first_decline(gates), {"kinds": F.col("kinds")}, module="module", function="callee")


@detector("RelocateMisplacedFunction", "calls.target", priority=40, enabled=False)
def relocate_misplaced_function(r, o):
    """The module that a function calls into most, its own left out."""
    uses = r["calls"].filter("target is not null and target <> module").withColumn("owner", F.concat_ws("#", "module", "caller"))
    rows = M.envy(uses, "owner", "target", o.get("refs", 2)).withColumns({"module": F.split_part("owner", F.lit("#"), F.lit(1)), "function": F.split_part("owner", F.lit("#"), F.lit(2))})
    return findings(rows, "RelocateMisplacedFunction", "feature_envy", F.col("decline"), {"target": F.col("target"), "n": F.col("n")}, module="module", function="function")


@detector("IntroduceContextObjectForParameterTrain", "clauses.params", enabled=False)
def parameter_train(r, o):
    rows = M.parameter_trains(r["clauses"].withColumn("params", F.array_sort("params")), "name", "params", o.get("least", 3))
    return findings(rows, "IntroduceContextObjectForParameterTrain", "parameter_train", evidence={"params": F.array_join("params", ","), "score": F.col("score")})


@detector("ExtractBehaviourFromAdapterFamily", "clauses")
def adapter_family(r, o):
    """Modules by the functions that they share: 10 a function, 30 for siblings, 15 for equal depth."""
    surface = r["clauses"].filter("public").select("module", F.concat_ws("/", "name", "arity").alias("function"))
    pairs = M.surface_pairs(surface, "module", "function", o.get("callbacks", 1))
    parent = lambda c: F.regexp_replace(c, r"\.?[^.]*$", "")
    depth = lambda c: F.size(F.split(c, r"\."))
    near = F.when(parent("a") == parent("b"), 30).when(depth("a") == depth("b"), 15).otherwise(0)
    rows = pairs.withColumn("score", F.col("shared") * 10 + near)
    return findings(rows, "ExtractBehaviourFromAdapterFamily", "adapter_family", evidence={"a": F.col("a"), "b": F.col("b"), "shared": F.col("shared"), "jaccard": F.col("jaccard"), "score": F.col("score")})


@detector("ExtractProtocolFromStructFamily", "clauses.struct")
def struct_family(r, o):
    rows = r["clauses"].filter("struct is not null").groupBy("name", "arity").agg(F.countDistinct("struct").alias("structs"), F.min("path").alias("path"), F.min("line").alias("line")).filter("structs > 1")
    return findings(rows, "ExtractProtocolFromStructFamily", "struct_family", first_decline([(F.col("structs") < o.get("least", 3), "too_few")]), {"structs": F.col("structs")}, function="name", arity="arity")


@detector("ExtractPrimitiveToStruct", "lists", enabled=False)
def primitive_shape(r, o):
    """Tuples of one arity whose positions always hold the same names, none of them twice."""
    shapes = r["lists"].filter(F.size("items") > 1).select(F.size("items").alias("size"), F.posexplode("items").alias("pos", "stem"))
    uses = r["lists"].filter(F.size("items") > 1).groupBy(F.size("items").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"), F.min("line").alias("line"))
    fixed = shapes.groupBy("size", "pos").agg(F.countDistinct("stem").alias("stems"), F.min("stem").alias("stem")).groupBy("size").agg(F.max("stems").alias("most"), F.countDistinct("stem").alias("names"))
    rows = uses.join(fixed, "size")
    gates = [(F.col("n") < o.get("least", 3), "too_few"), (F.col("most") > 1, "names_vary"), (F.col("names") < F.col("size"), "repeated_name")]
    return findings(rows, "ExtractPrimitiveToStruct", "primitive_shape", first_decline(gates), {"size": F.col("size"), "n": F.col("n")})


@detector("InlineDefdelegate", "clauses.delegate", "calls", priority=40, enabled=False)
def inline_delegate(r, o):
    uses = r["calls"].groupBy(F.col("callee").alias("name")).agg(F.count(F.lit(1)).alias("uses"))
    rows = r["clauses"].filter("delegate is not null").join(uses, "name", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return findings(rows, "InlineDefdelegate", "delegate", evidence={"target": F.col("delegate"), "uses": F.col("uses")}, module="module", function="name", arity="arity")


@detector("SplitLowCohesionModule", "clauses", "calls", priority=10, enabled=False)
def split_low_cohesion_module(r, o):
    """Call-graph communities of a module behind its gates, in order: size, clusters, modularity, cut, sizeable."""
    key = ["module"]
    functions = r["clauses"].select("module", "name").distinct()
    both = r["calls"].select("module", F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()
    both = both.join(functions.select("module", F.col("name").alias("src")), ["module", "src"]).join(functions.select("module", F.col("name").alias("dst")), ["module", "dst"])
    edges = graphs.undirected(both.withColumn("w", F.lit(1.0)), by=("module",))
    found = graphs.communities(edges.withColumnRenamed("module", "graph_id")).withColumnRenamed("graph_id", "module")
    q = graphs.modularity(edges, found, ("module",))
    cut = graphs.cut_ratio(edges, found, ("module",))
    sizes = found.groupBy("module", "community").agg(F.count(F.lit(1)).alias("size")).groupBy("module").agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("size") >= o.get("cluster_size", 2)).alias("sizeable"))
    places = r["clauses"].groupBy("module").agg(F.countDistinct("name", "arity").alias("functions"), F.min("path").alias("path"), F.min("line").alias("line"))
    rows = places.join(q, key, "left").join(cut, key, "left").join(sizes, key, "left")
    gates = [
        (F.col("functions") < o.get("functions", 6), "too_small"),
        (F.coalesce("clusters", F.lit(1)) < 2, "one_cluster"),
        (F.coalesce("q", F.lit(0.0)) < o.get("modularity", 0.3), "low_modularity"),
        (F.col("cut") > o.get("cut", 0.25), "wide_cut"),
        (F.col("sizeable") < 2, "one_sizeable_cluster"),
    ]
    return findings(rows, "SplitLowCohesionModule", "low_cohesion", first_decline(gates), {"functions": F.col("functions"), "clusters": F.col("clusters"), "q": F.round("q", 4), "cut": F.round("cut", 4)}, module="module", confidence=F.col("q"))


@detector("SuggestInputStructsForProtocol", "clauses")
def suggest_input_structs(r, o):
    """Families of functions named ``*_to_X`` with one X."""
    suffix = F.regexp_extract("name", r"_to_(\w+)$", 1)
    rows = r["clauses"].withColumn("suffix", suffix).filter("suffix <> ''").groupBy("suffix").agg(F.countDistinct("name").alias("members"), F.min("path").alias("path"), F.min("line").alias("line"))
    return findings(rows, "SuggestInputStructsForProtocol", "conversion_family", first_decline([(F.col("members") < o.get("least", 3), "too_few")]), {"suffix": F.col("suffix"), "members": F.col("members")})


# Statements of a block.


def _ordered(r) -> Window:
    return Window.partitionBy("path", "block").orderBy("idx")


@detector("UnusedVariable", "segments")
def unused_variable(r, o):
    writes = r["segments"].select("path", "block", "idx", "line", F.explode("writes").alias("name")).filter(~F.col("name").startswith("_"))
    reads = r["segments"].select("path", "block", F.explode("reads").alias("name")).distinct()
    return findings(writes.join(reads, ["path", "block", "name"], "left_anti"), "UnusedVariable", "unused_variable", evidence={"name": F.col("name")})


@detector("InlineSingleUseBinding", "segments")
def inline_single_use_binding(r, o):
    writes = r["segments"].filter(F.size("writes") == 1).select("path", "block", "idx", "line", "pure", F.get("writes", F.lit(0)).alias("name"))
    reads = r["segments"].select("path", "block", F.col("idx").alias("at"), F.explode("reads").alias("name")).groupBy("path", "block", "name").agg(F.count(F.lit(1)).alias("uses"), F.min("at").alias("at"))
    rows = writes.join(reads, ["path", "block", "name"]).filter("uses = 1")
    return findings(rows, "InlineSingleUseBinding", "single_use", first_decline([(F.col("at") != F.col("idx") + 1, "not_adjacent"), (~F.col("pure"), "impure")]), {"name": F.col("name")})


@detector("DropTrailingReturnBinding", "segments")
def drop_trailing_return_binding(r, o):
    last = F.max("idx").over(Window.partitionBy("path", "block"))
    before = F.lag("writes").over(_ordered(r))
    rows = r["segments"].withColumns({"last": last, "before": before}).filter((F.col("idx") == F.col("last")) & F.col("callee").isNull() & (F.size("reads") == 1) & (F.size("before") == 1) & (F.get("reads", F.lit(0)) == F.get("before", F.lit(0))))
    return findings(rows, "DropTrailingReturnBinding", "trailing_binding", evidence={"name": F.get("reads", F.lit(0))})


def _islands(r, same: Column, least: int) -> DataFrame:
    """Runs of at least ``least`` statements for which ``same`` holds after the first."""
    w = _ordered(r)
    marked = r["segments"].withColumn("_same", F.coalesce(same, F.lit(False))).withColumn("_run", F.sum((~F.col("_same")).cast("int")).over(w))
    return marked.groupBy("path", "block", "_run").agg(F.min("line").alias("line"), F.min("idx").alias("first"), F.count(F.lit(1)).alias("length")).filter(F.col("length") >= least)


@detector("PipelineFromRebindChain", "segments")
def pipeline_from_rebind_chain(r, o):
    w = _ordered(r)
    same = (F.size("writes") == 1) & (F.lag("writes").over(w) == F.col("writes")) & F.array_contains("reads", F.get("writes", F.lit(0)))
    return findings(_islands(r, same, 2), "PipelineFromRebindChain", "rebind_chain", evidence={"length": F.col("length")})


@detector("MergePipeableAssignments", "segments")
def merge_pipeable_assignments(r, o):
    """Runs in which each statement reads just what the one before wrote, and nothing later does."""
    w = _ordered(r)
    before = F.lag("writes").over(w)
    counted = r["segments"].select("path", "block", F.explode("reads").alias("name")).groupBy("path", "block", "name").agg(F.count(F.lit(1)).alias("n"))
    once = counted.filter("n = 1").groupBy("path", "block").agg(F.collect_set("name").alias("once"))
    rows = {**r, "segments": r["segments"].join(once, ["path", "block"], "left")}
    same = (F.size(before) == 1) & F.array_contains("reads", F.get(before, F.lit(0))) & F.array_contains("once", F.get(before, F.lit(0)))
    return findings(_islands(rows, same, 2), "MergePipeableAssignments", "linear_chain", evidence={"length": F.col("length")})


@detector("MergeAssignKeywords", "segments", priority=120)
def merge_assign_keywords(r, o):
    w = _ordered(r)
    same = (F.col("callee") == "assign") & (F.lag("callee").over(w) == "assign") & (F.lag("writes").over(w) == F.col("writes"))
    return findings(_islands(r, same, 2), "MergeAssignKeywords", "assign_run", evidence={"length": F.col("length")})


@detector("PipeReassign", "segments", priority=200)
def pipe_reassign(r, o):
    rows = r["segments"].filter((F.size("writes") == 1) & F.col("callee").isNotNull() & (F.get("reads", F.lit(0)) == F.get("writes", F.lit(0))))
    return findings(rows, "PipeReassign", "reassign", evidence={"name": F.get("writes", F.lit(0))})


@detector("ExtractNestedBlock", "segments")
def extract_nested_block(r, o):
    rows = r["segments"].groupBy("path", "block").agg(F.max("depth").alias("depth"), F.min("line").alias("line")).filter(F.col("depth") > o.get("depth", 2))
    return findings(rows, "ExtractNestedBlock", "nested_block", evidence={"depth": F.col("depth")})


@detector("ExtractPipelineToFunction", "segments.stages")
def extract_pipeline_to_function(r, o):
    return findings(r["segments"].filter(F.col("stages") >= o.get("stages", 5)), "ExtractPipelineToFunction", "long_pipeline", evidence={"stages": F.col("stages")})


def _per_block(segments: DataFrame, run, schema: str) -> DataFrame:
    ship(segments.sparkSession)
    return segments.groupBy("path", "block").applyInPandas(run, schema)


def _frame(pdf: pd.DataFrame) -> list[S.Segment]:
    return [S.Segment(frozenset(r.reads), frozenset(r.writes), r.hash, int(r.mass)) for r in pdf.sort_values("idx").itertuples()]


@detector("SplitPipeableResponsibilities", "segments", enabled=False)
def split_pipeable_responsibilities(r, o):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cuts = S.cuts(_frame(pdf), o.get("statements", 2), o.get("carriers", 3), o.get("phases", 3))
        return pd.DataFrame([(pdf.path.iloc[0], int(pdf.line.min()), ",".join(map(str, cuts)))], columns=["path", "line", "cuts"])

    rows = _per_block(r["segments"].select("path", "block", "idx", "line", "reads", "writes", "hash", "mass"), run, "path string, line int, cuts string")
    return findings(rows, "SplitPipeableResponsibilities", "phases", first_decline([(F.col("cuts") == "", "too_few_phases")]), {"cuts": F.col("cuts")})


@detector("CanonicalStatementOrder", "segments", priority=300)
def canonical_statement_order(r, o):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = S.canonical_order(_frame(pdf))
        moved = sum(a != b for a, b in zip(order, range(len(order)))) if len(order) >= o.get("statements", 3) else 0
        return pd.DataFrame([(pdf.path.iloc[0], int(pdf.line.min()), moved)], columns=["path", "line", "moved"])

    rows = _per_block(r["segments"].select("path", "block", "idx", "line", "reads", "writes", "hash", "mass"), run, "path string, line int, moved int")
    return findings(rows.filter("moved > 0"), "CanonicalStatementOrder", "statement_order", evidence={"moved": F.col("moved")})


@detector("ExtractExpressionClone", "segments", enabled=False)
def extract_expression_clone(r, o):
    """Statement windows that recur: the hashes of all windows are rows, repeated ones meet by equality."""
    w = Window.partitionBy("path", "block").orderBy("idx")
    rows = r["segments"]
    longest = o.get("longest", 8)
    ahead = lambda c: F.collect_list(c).over(w.rowsBetween(0, longest - 1))
    windows = rows.withColumns({"hs": ahead("hash"), "ms": ahead("mass")}).select("path", "block", "idx", "line", "hs", "ms", F.explode(F.sequence(F.lit(2), F.greatest(F.size("hs"), F.lit(2)))).alias("size")).filter(F.col("size") <= F.size("hs"))
    keyed = windows.withColumns({"key": F.sha2(F.array_join(F.slice("hs", 1, F.col("size")), ","), 256), "mass": F.aggregate(F.slice("ms", 1, F.col("size")), F.lit(0).cast("long"), lambda a, x: a + x)})
    groups = keyed.filter(F.col("mass") >= o.get("min_mass", 8)).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("mass").alias("mass"), F.min("path").alias("path"), F.min("line").alias("line"), F.min("size").alias("size")).filter("n > 1")
    return findings(groups, "ExtractExpressionClone", "expression_clone", first_decline([((F.col("n") - 1) * F.col("mass") < o.get("savings", 12), "saves_too_little")]), {"n": F.col("n"), "mass": F.col("mass"), "size": F.col("size")})


# Branches of a conditional.


def _shared_ends(branches: DataFrame, from_end: bool) -> DataFrame:
    """How many statements all branches of a site begin (or end) with."""
    w = Window.partitionBy("path", "site", "branch")
    rows = branches.withColumn("k", F.max("idx").over(w) - F.col("idx") if from_end else F.col("idx") - F.min("idx").over(w))
    sites = branches.groupBy("path", "site").agg(F.countDistinct("branch").alias("branches"), F.min("line").alias("line"))
    level = rows.groupBy("path", "site", "k").agg(F.countDistinct("hash").alias("kinds"), F.countDistinct("branch").alias("have")).join(sites, ["path", "site"])
    same = level.filter("kinds = 1 and have = branches and branches > 1").withColumn("rank", F.row_number().over(Window.partitionBy("path", "site").orderBy("k")) - 1)
    return same.filter("rank = k").groupBy("path", "site", "branches", "line").agg(F.count(F.lit(1)).alias("shared"))


@detector("DedupeClausePrologue", "branches")
def dedupe_clause_prologue(r, o):
    return findings(_shared_ends(r["branches"], False), "DedupeClausePrologue", "shared_prologue", evidence={"shared": F.col("shared"), "branches": F.col("branches")})


@detector("LiftCommonTailFromBranches", "branches")
def lift_common_tail(r, o):
    return findings(_shared_ends(r["branches"], True), "LiftCommonTailFromBranches", "shared_tail", evidence={"shared": F.col("shared"), "branches": F.col("branches")})


@detector("SinkBindingIntoBranches", "branches.reads")
def sink_binding(r, o):
    rows = r["branches"].select("path", "site", "branch", "line", F.explode("reads").alias("name")).groupBy("path", "site", "name").agg(F.countDistinct("branch").alias("branches"), F.min("line").alias("line")).filter("branches = 1")
    return findings(rows, "SinkBindingIntoBranches", "single_branch_binding", evidence={"name": F.col("name")})


# Lists.


@detector("SortKeywords", "lists", priority=30)
def sort_keywords(r, o):
    rows = r["lists"].filter(~F.col("items").eqNullSafe(F.array_sort("items")))
    return findings(rows, "SortKeywords", "unsorted_keywords", evidence={"sorted": F.array_join(F.array_sort("items"), ",")})


@detector("ResolveImplTrue", "callbacks", "sites")
def resolve_impl_true(r, o):
    """Sites that match the callbacks of exactly one behaviour."""
    rows = r["sites"].join(r["callbacks"].select("behaviour", "name", "arity"), ["name", "arity"], "left").groupBy("path", "line", "name", "arity").agg(F.countDistinct("behaviour").alias("n"), F.min("behaviour").alias("behaviour"))
    return findings(rows, "ResolveImplTrue", "impl_true", first_decline([(F.col("n") == 0, "no_behaviour"), (F.col("n") > 1, "ambiguous")]), {"behaviour": F.col("behaviour")}, function="name", arity="arity")


# Markup.


def _attribute(name: str) -> Column:
    return F.get(F.filter("attrs", lambda a: a["name"] == name), F.lit(0))["value"]


@detector("HeexAttributeBundleToComponent", "elements", enabled=False)
def attribute_bundle(r, o):
    shells = r["elements"].filter("kind = 'element' and size(attrs) >= 2").withColumn("shell", F.array_join(F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), a["value"])), " "))
    rows = M.attribute_bundles(shells, "label", "shell", o.get("least", 2)).join(shells.groupBy("label", "shell").agg(F.min("path").alias("path"), F.min("line").alias("line")), ["label", "shell"])
    return findings(rows, "HeexAttributeBundleToComponent", "attribute_bundle", evidence={"tag": F.col("label"), "shell": F.col("shell"), "n": F.col("n")})


@detector("DropRedundantAttrDefaults", "elements", "defaults")
def redundant_defaults(r, o):
    """Attributes whose literal value is the component's declared default."""
    uses = r["elements"].filter("kind = 'element'").select("path", "line", F.col("label").alias("component"), F.explode("attrs").alias("a")).select("path", "line", "component", F.col("a.name").alias("attr"), F.col("a.kind").alias("kind"), F.col("a.value").alias("value"))
    rows = uses.join(r["defaults"].select("component", "attr", "default"), ["component", "attr"]).filter("kind = 'string' and value = default")
    return findings(rows, "DropRedundantAttrDefaults", "redundant_default", evidence={"component": F.col("component"), "attr": F.col("attr")})


@detector("NormalizeComponentInvocationOrder", "elements", "declared", priority=10, enabled=False)
def invocation_order(r, o):
    """Call sites whose attributes are not in the declared order."""
    declared = r["declared"].groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "attr"))), lambda x: x["attr"]).alias("order"))
    uses = r["elements"].filter("kind = 'element'").withColumn("names", F.transform("attrs", lambda a: a["name"])).join(declared, F.col("label") == F.col("component"))
    known = F.array_intersect("names", "order")
    rows = uses.filter(~known.eqNullSafe(F.array_intersect("order", "names")))
    return findings(rows, "NormalizeComponentInvocationOrder", "attribute_order", evidence={"component": F.col("component"), "now": F.array_join(known, ",")})


@detector("GenerateHeexAssignContracts", "elements", "declared", enabled=False)
def assign_contracts(r, o):
    """Assigns that a file's templates use and no declaration names."""
    codes = F.concat(F.transform(F.filter("attrs", lambda a: a["kind"] == "expr"), lambda a: a["value"]), F.when(F.col("kind").isin("expr", "block"), F.array("label")).otherwise(F.array().cast("array<string>")))
    used = r["elements"].select("path", "line", F.explode(codes).alias("code")).select("path", "line", F.explode(F.regexp_extract_all("code", F.lit("@([a-z_][a-zA-Z0-9_]*)"), F.lit(1))).alias("attr")).groupBy("path", "attr").agg(F.min("line").alias("line"))
    return findings(used.join(r["declared"].select("attr").distinct(), "attr", "left_anti"), "GenerateHeexAssignContracts", "missing_contract", evidence={"attr": F.col("attr")})


@detector("ExtractHeexFor", "elements")
def extract_for(r, o):
    loops = r["elements"].filter("kind = 'block' and label like '%for %'").select("path", "tree_id", "node_id", "line", F.col("mass"), (F.col("node_id") + F.col("mass") - 1).alias("last_node"))
    ends = r["elements"].select("path", "tree_id", F.col("node_id").alias("last_node"), F.col("line").alias("last_line"))
    rows = loops.join(ends, ["path", "tree_id", "last_node"]).withColumn("lines", F.col("last_line") - F.col("line") + 1)
    return findings(rows, "ExtractHeexFor", "for_body", first_decline([(F.col("lines") < o.get("lines", 4), "too_short")]), {"lines": F.col("lines")})


@detector("ExtractHeexComponentBySeam", "elements", priority=10, enabled=False)
def component_by_seam(r, o):
    """Subtrees of enough nodes and lines whose assigns are hardly used outside.

    A node's subtree is an interval of pre-order numbers; uses inside and outside are counted
    by an interval join within one tree.
    """
    codes = F.concat(F.transform(F.filter("attrs", lambda a: a["kind"] == "expr"), lambda a: a["value"]), F.when(F.col("kind").isin("expr", "block"), F.array("label")).otherwise(F.array().cast("array<string>")))
    uses = r["elements"].select("path", "tree_id", F.col("node_id").alias("at"), F.explode(codes).alias("code")).select("path", "tree_id", "at", F.explode(F.regexp_extract_all("code", F.lit("@([a-z_][a-zA-Z0-9_]*)"), F.lit(1))).alias("assign"))
    trees = r["elements"].filter("kind = 'element' and parent_id >= 0").filter(F.col("mass") >= o.get("nodes", 6)).select("path", "tree_id", "node_id", "line", "mass")
    last = r["elements"].select("path", "tree_id", F.col("node_id").alias("end"), F.col("line").alias("end_line"))
    trees = trees.withColumn("end", F.col("node_id") + F.col("mass") - 1).join(last, ["path", "tree_id", "end"]).withColumn("lines", F.col("end_line") - F.col("line") + 1)
    inside = trees.join(uses, ["path", "tree_id"]).withColumn("in", (F.col("at") >= F.col("node_id")) & (F.col("at") <= F.col("end")))
    per = inside.groupBy("path", "tree_id", "node_id", "line", "mass", "lines", "assign").agg(F.bool_or("in").alias("in"), F.bool_or(~F.col("in")).alias("out"))
    rows = per.groupBy("path", "tree_id", "node_id", "line", "mass", "lines").agg(F.count_if("in").alias("assigns"), (F.count_if(F.col("in") & F.col("out")) / F.greatest(F.count_if("in"), F.lit(1))).alias("leak"))
    gates = [(F.col("lines") < o.get("lines", 12), "too_short"), (F.col("assigns") < 1, "no_assign"), (F.col("leak") > o.get("leak", 0.25), "seam_leaks")]
    return findings(rows, "ExtractHeexComponentBySeam", "seam", first_decline(gates), {"nodes": F.col("mass"), "lines": F.col("lines"), "leak": F.round("leak", 2)})


@detector("ConvertLiveComponentToFunction", "elements", "handlers", enabled=False)
def live_component(r, o):
    """Live components whose module handles no events."""
    uses = r["elements"].filter("kind = 'element' and label = '.live_component'").withColumn("component", _attribute("module"))
    rows = uses.join(r["handlers"].select("component").distinct().withColumn("stateful", F.lit(True)), "component", "left")
    return findings(rows, "ConvertLiveComponentToFunction", "stateless_component", first_decline([(F.col("stateful"), "handles_events")]), {"component": F.col("component")})


@detector("SplitRootConditionalComponent", "elements", enabled=False)
def root_conditional(r, o):
    roots = r["elements"].filter("parent_id < 0").groupBy("path", "tree_id").agg(F.count(F.lit(1)).alias("roots"), F.min("line").alias("line"), F.max(F.when((F.col("kind") == "block") & F.col("label").startswith("if "), F.col("label"))).alias("condition"))
    return findings(roots.filter("roots = 1 and condition is not null"), "SplitRootConditionalComponent", "root_conditional", evidence={"condition": F.col("condition")})


@detector("CssClassClusterCorrection", "elements", enabled=False)
def class_cluster_correction(r, o):
    sites = r["elements"].filter("kind = 'element'").select("tree_id", F.col("node_id").alias("site_id"), "line", F.col("path").alias("file"), F.array_sort(F.array_distinct(F.filter(F.split(_attribute("class"), r"\s+"), lambda t: t != ""))).alias("tokens")).filter("size(tokens) > 0")
    swaps = M.outlier_swaps(M.set_clusters(sites), M.pair_weights(sites), o.get("min_support", 8), o.get("dominance", 20))
    rows = sites.join(swaps, sites["tokens"] == swaps["set"]).withColumn("path", F.col("file"))
    return findings(rows, "CssClassClusterCorrection", "class_outlier", evidence={"bad": F.col("bad"), "good": F.col("good"), "support": F.col("support")})


# Lines of source.


def _line_pattern(name: str, kind: str, pattern: str, priority: int = 100) -> None:
    """A rule that reports lines by a pattern; its first group is the evidence."""

    @detector(name, "lines", priority=priority)
    def by_line(r, o):
        rows = r["lines"].withColumn("found", F.regexp_extract("text", pattern, 1)).filter("found <> ''")
        return findings(rows, name, kind, evidence={"text": F.col("found")})


_line_pattern("LiftPinnedEctoExpr", "pinned_expression", r"\^(\((?:[^()]|\([^()]*\))*\)|\w+(?:\.\w+|\()[^\s,)\]]*)", 120)
_line_pattern("LiftDirectives", "nested_directive", r"^(?: {4,}|\t{2,})((?:alias|import|require) [A-Z][\w.]*)", 220)
_line_pattern("BooleanFunctionQuestionMark", "boolean_name", r"^\s*defp ((?:is|has|can|should)_\w+)\(", 250)
_line_pattern("LiftWithIntoPipeline", "single_clause_with", r"^\s*(with (?:(?! <- ).)+ <- (?:(?! <- ).)+ do)\s*$", 150)


@detector("AliasUsage", "lines", priority=220)
def alias_usage(r, o):
    """Module names of several parts that a file spells out more than once; two with one last part decline."""
    found = F.regexp_extract_all("text", F.lit(r"\b([A-Z]\w*(?:\.[A-Z]\w*)+)"), F.lit(1))
    uses = r["lines"].filter(~F.col("text").rlike(r"^\s*(alias|import|require|use|defmodule) ")).select("path", "line", F.explode(found).alias("name"))
    rows = uses.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line")).withColumn("last", F.substring_index("name", ".", -1))
    rows = rows.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("path", "last")))
    return findings(rows.filter(F.col("n") >= o.get("least", 2)), "AliasUsage", "alias", first_decline([(F.col("same") > 1, "last_part_clashes")]), {"name": F.col("name"), "n": F.col("n")})


# Names: ``names`` has path, line, kind, short and candidates array<struct<name:string,strong:boolean>>.


def _expansion(rule: str, kind: str) -> None:
    @detector(rule, "names", priority=250)
    def expand(r, o):
        from coppice.functions.naming import resolve

        ship(r["names"].sparkSession)

        @F.pandas_udf("string")
        def best(short: pd.Series, candidates: pd.Series) -> pd.Series:
            return pd.Series([resolve(s, [(c["name"], c["strong"]) for c in cs], o.get("min_score", 80)) for s, cs in zip(short, candidates)], dtype=object)

        rows = r["names"].filter(F.col("kind") == kind).withColumn("long", best("short", "candidates"))
        return findings(rows, rule, "short_name", first_decline([(F.col("long").isNull(), "no_clear_expansion")]), {"short": F.col("short"), "long": F.col("long")})


for _rule, _kind in (("ExpandShortFormBindings", "binding"), ("ExpandShortFormFunctions", "function"), ("ExpandShortFormParams", "param")):
    _expansion(_rule, _kind)


# More of statements and branches.


@detector("ExtractCaseToHelper", "segments")
def extract_case_to_helper(r, o):
    last = F.max("idx").over(Window.partitionBy("path", "block"))
    rows = r["segments"].withColumn("last", last).filter((F.col("idx") == F.col("last")) & (F.col("callee") == "case") & (F.col("idx") > 0))
    return findings(rows, "ExtractCaseToHelper", "tail_case")


@detector("ExtractCommonProlog", "segments")
def extract_common_prolog(r, o):
    """Blocks that begin with the same statements."""
    n = o.get("statements", 2)
    starts = r["segments"].filter(F.col("idx") < n).groupBy("path", "block").agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("h"), F.min("line").alias("line")).filter(F.size("h") == n)
    rows = starts.groupBy(F.transform("h", lambda x: x["hash"]).alias("prolog")).agg(F.count(F.lit(1)).alias("blocks"), F.min("path").alias("path"), F.min("line").alias("line")).filter("blocks > 1")
    return findings(rows, "ExtractCommonProlog", "common_prolog", evidence={"blocks": F.col("blocks"), "statements": F.lit(n)})


@detector("ExtractFunctionFromBlock", "segments")
def extract_function_from_block(r, o):
    """The leading bindings of a block, its parameters and what lives on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = _frame(pdf)
        k = next((i for i, s in enumerate(block) if not s.writes), len(block))
        live, free = S.live_out(block, k), set().union(*(s.reads for s in block[:k])) - set().union(*(s.writes for s in block[:k])) if k else set()
        return pd.DataFrame([(pdf.path.iloc[0], int(pdf.line.min()), k, len(live), ",".join(sorted(free)))], columns=["path", "line", "n", "live", "params"])

    rows = _per_block(r["segments"].select("path", "block", "idx", "line", "reads", "writes", "hash", "mass"), run, "path string, line int, n int, live int, params string")
    gates = [(F.col("n") < o.get("statements", 3), "too_short"), (F.col("live") > o.get("live", 3), "too_much_lives_on"), (F.col("live") == 0, "nothing_lives_on")]
    return findings(rows.filter("n > 0"), "ExtractFunctionFromBlock", "leading_bindings", first_decline(gates), {"statements": F.col("n"), "params": F.col("params")})


@detector("LiftLocalLambda", "segments")
def lift_local_lambda(r, o):
    rows = r["segments"].filter((F.col("callee") == "fn") & (F.size("writes") == 1))
    return findings(rows, "LiftLocalLambda", "local_lambda", evidence={"name": F.get("writes", F.lit(0)), "params": F.array_join(F.array_sort("reads"), ",")})


@detector("MergeSequentialReduces", "segments", priority=150)
def merge_sequential_reduces(r, o):
    """Neighbouring reductions of one collection."""
    w = _ordered(r)
    kinds = ("Enum.reduce", "reduce", "Enum.sum", "Enum.count")
    same = F.col("callee").isin(*kinds) & F.lag("callee").over(w).isin(*kinds) & (F.get("reads", F.lit(0)) == F.get(F.lag("reads").over(w), F.lit(0)))
    return findings(_islands(r, same, 2), "MergeSequentialReduces", "reductions", evidence={"length": F.col("length")})


@detector("HoistInvariantOutOfComprehension", "segments")
def hoist_invariant(r, o):
    """Pure statements inside a loop that read nothing the loop binds."""
    inner = r["segments"].filter("depth > 1 and pure and size(writes) = 1")
    bound = r["segments"].filter("depth > 1").select("path", "block", F.explode("writes").alias("name")).distinct()
    reads = inner.select("path", "block", "idx", F.explode("reads").alias("name")).join(bound, ["path", "block", "name"], "left_semi").select("path", "block", "idx").distinct()
    return findings(inner.join(reads, ["path", "block", "idx"], "left_anti"), "HoistInvariantOutOfComprehension", "loop_invariant", evidence={"name": F.get("writes", F.lit(0))})


@detector("FlattenDeepPipeBranch", "branches")
def flatten_deep_pipe_branch(r, o):
    """Conditionals whose branches share a beginning and an end."""
    heads = _shared_ends(r["branches"], False).select("path", "site", F.col("shared").alias("before"))
    both = _shared_ends(r["branches"], True).join(heads, ["path", "site"])
    return findings(both, "FlattenDeepPipeBranch", "shared_pipe", evidence={"before": F.col("before"), "after": F.col("shared")})


# Types by use: ``uses`` has path, line, function, param, fields array; ``structs`` has struct, fields array.


@detector("LiftUntypedParamToStructPattern", "uses", "structs")
def lift_untyped_param(r, o):
    """Parameters whose fields lie in exactly one struct: fields meet by equality and are counted."""
    uses = r["uses"].withColumn("fields", F.array_distinct("fields")).withColumn("need", F.size("fields"))
    key = ["path", "line", "function", "param", "need"]
    fields = uses.select(*key, F.explode("fields").alias("field"))
    known = r["structs"].select("struct", F.explode(F.array_distinct("fields")).alias("field"))
    fits = fields.join(known, "field").groupBy(*key, "struct").agg(F.count(F.lit(1)).alias("have")).filter("have = need").groupBy(*key).agg(F.count(F.lit(1)).alias("structs"), F.min("struct").alias("struct"))
    rows = uses.select(*key).distinct().join(fits, key, "left").withColumn("structs", F.coalesce("structs", F.lit(0)))
    gates = [(F.col("need") < o.get("min_fields", 2), "too_few_fields"), (F.col("structs") == 0, "no_struct"), (F.col("structs") > 1, "ambiguous")]
    return findings(rows, "LiftUntypedParamToStructPattern", "struct_param", first_decline(gates), {"param": F.col("param"), "struct": F.col("struct")}, function="function")


# Markup fragments: ``fragments`` as ``clones.fragments`` gives them, ``near`` as ``clones.near_clusters`` does.


@detector("ExtractHeexExactClone", "fragments")
def exact_clone(r, o):
    from coppice.operators import clones as C

    found = C.without_subsets(C.exact_clusters(r["fragments"].filter((F.col("mode") == "exact") & (F.col("mass") >= o.get("min_mass", 8)))))
    rows = found.select(F.col("representative.file").cast("string").alias("path"), F.col("representative.line").alias("line"), "mass", "occurrences")
    return findings(rows, "ExtractHeexExactClone", "exact_clone", evidence={"mass": F.col("mass"), "n": F.col("occurrences")})


@detector("ProposeSharedHeexComponent", "fragments", priority=10, enabled=False)
def shared_component(r, o):
    from coppice.operators import clones as C

    found = C.without_subsets(C.motifs(r["fragments"].filter((F.col("mode") == "motif") & (F.col("mass") >= o.get("min_mass", 8))), o.get("occurrences", 3), o.get("files", 2)))
    return findings(found, "ProposeSharedHeexComponent", "shared_motif", evidence={"mass": F.col("mass"), "n": F.col("occurrences"), "files": F.col("files")})


@detector("ExtractToPublicComponent", "fragments", priority=10, enabled=False)
def public_component(r, o):
    rows = r["fragments"].filter(F.col("mode") == "exact").withColumn("path", F.col("file").cast("string"))
    rows = rows.withColumn("lines", F.col("end_line") - F.col("line") + 1) if "end_line" in rows.columns else rows.withColumn("lines", F.lit(None).cast("int"))
    gates = [(F.col("motif") == "unknown", "no_motif"), (F.col("mass") < o.get("nodes", 6), "too_small"), (F.col("lines") < o.get("lines", 12), "too_short")]
    return findings(rows.filter("kind = 'element'"), "ExtractToPublicComponent", "public_component", first_decline(gates), {"motif": F.col("motif"), "mass": F.col("mass")})


def _near(rule: str, kind: str, mass: int) -> None:
    @detector(rule, "near", enabled=False)
    def merge(r, o):
        rows = r["near"].filter("members > 1").withColumn("path", F.col("file").cast("string"))
        gates = [(F.col("mass") < o.get("min_mass", mass), "too_small"), (~F.col("mergeable"), "structural_difference")]
        return findings(rows, rule, kind, first_decline(gates), {"mass": F.col("mass"), "n": F.col("occurrences")})


_near("MergeNearCloneComponents", "near_component", 12)
_near("MergeNearCloneFunctions", "near_function", 40)
