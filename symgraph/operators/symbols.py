"""The global symbol table: registration, look-ups, and prioritised resolution.

Every rule of a resolution is an equi-join that gives candidates with a
priority; one aggregation per call picks the best.  Calls that ask the same
are resolved once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.scalars import arity, arity_by_commas, cpp_arity, package_of, scope_of, simple_name, unresolved_usr
from symgraph.operators.ingest import union_all
from symgraph.storage import stored


def register(existing: DataFrame | None, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows after replacing by two unique keys, fqn and usr, in the order of ``seq``.

    A row stays just if it is the last of its fqn and the last of its usr, over
    all rows; what exists comes before what is new.
    """
    rows = new.withColumn("__at", F.struct(F.lit(1).alias("new"), F.col(seq).cast("long").alias("seq")))
    if existing is not None:
        rows = existing.withColumn("__at", F.struct(F.lit(0).alias("new"), F.col(seq).cast("long").alias("seq"))).unionByName(rows)
    by_fqn = rows.groupBy("fqn").agg(F.max("__at").alias("__at"))
    by_usr = rows.groupBy("usr").agg(F.max("__at").alias("__at"))
    return rows.join(by_fqn, ["fqn", "__at"], "left_semi").join(by_usr, ["usr", "__at"], "left_semi").drop("__at")


def with_keys(symbols: DataFrame) -> DataFrame:
    """Symbols with the derived columns that resolution joins on."""
    bare = F.substring_index("fqn", "(", 1)
    name = simple_name("fqn") if "simple_name" not in symbols.columns else F.col("simple_name")
    return symbols.withColumns({"simple_name": name, "package": F.when(F.contains(bare, F.lit(".")), package_of(bare)), "arity": arity("signature")})


def lookup_fqn(symbols: DataFrame, fqn: str) -> DataFrame:
    return symbols.where(F.col("fqn") == fqn)


def lookup_usr(symbols: DataFrame, usr: str) -> DataFrame:
    return symbols.where(F.col("usr") == usr)


def all_classes(symbols: DataFrame, language: str | None = None) -> DataFrame:
    found = symbols.where(F.col("kind").isin("class", "interface"))
    return found if language is None else found.where(F.col("language") == language)


def class_methods(symbols: DataFrame, class_fqn: str) -> DataFrame:
    return symbols.where((F.col("parent_fqn") == class_fqn) & F.col("kind").isin("method", "function", "constructor"))


def _best(candidates: list[DataFrame], key: str) -> DataFrame:
    return union_all(candidates).groupBy(key).agg(F.min_by(F.struct("usr", "fqn"), F.struct("prio", "pos", "fqn", "usr")).alias("b")).select(key, "b.usr", "b.fqn")


def resolve_names(calls: DataFrame, symbols: DataFrame, compat: bool = False) -> DataFrame:
    """(call_id, usr, fqn) of calls (call_id, name, context, imports) that resolve.

    In order: the qualified name itself; a member of the context; by import, in
    order, explicit or of a package; any symbol of that simple name; ties by
    qualified name.  ``compat`` matches contexts, packages and suffixes as
    patterns, without regard to case.
    """
    keyed = with_keys(symbols)
    zero = F.lit(0)
    take = lambda df, prio, pos=zero: df.select("call_id", F.lit(prio).alias("prio"), pos.alias("pos"), "fqn", "usr")
    if compat:
        low = F.lower("fqn")
        member = F.contains(low, F.lower(F.concat_ws(".", "context", "name")))
        return _best(
            [
                take(calls.join(keyed, F.col("fqn") == F.col("name")), 1),
                take(calls.where("context IS NOT NULL").join(keyed, member), 2),
                take(calls.join(keyed, (F.col("parent_fqn") == F.col("context")) & F.contains(low, F.lower(F.concat(F.lit("."), "name")))), 3),
                take(calls.select("*", F.posexplode("imports").alias("pos", "imp")).where(F.endswith("imp", F.concat(F.lit("."), "name")) | F.endswith("imp", F.lit(".*"))).join(keyed, F.startswith(low, F.lower(F.concat_ws(".", package_of("imp"), "name")))), 4, F.col("pos")),
                take(calls.join(keyed, F.endswith(low, F.lower(F.concat(F.lit("."), "name")))), 5),
            ],
            "call_id",
        )
    imports = calls.select("call_id", "name", F.posexplode("imports").alias("pos", "imp"))
    explicit = imports.where(F.endswith("imp", F.concat(F.lit("."), "name"))).select("call_id", "pos", F.col("imp").alias("fqn"))
    wildcard = imports.where(F.endswith("imp", F.lit(".*"))).select("call_id", "pos", F.col("name").alias("simple_name"), package_of("imp").alias("package"))
    return _best(
        [
            take(calls.select("call_id", F.col("name").alias("fqn")).join(keyed, "fqn"), 1),
            take(calls.select("call_id", F.col("name").alias("simple_name"), F.col("context").alias("parent_fqn")).join(keyed, ["parent_fqn", "simple_name"]), 2),
            take(explicit.join(keyed, "fqn"), 4, F.col("pos")),
            take(wildcard.join(keyed, ["package", "simple_name"]), 4, F.col("pos")),
            take(calls.select("call_id", F.col("name").alias("simple_name")).join(keyed.groupBy("simple_name").agg(F.min(F.struct("fqn", "usr")).alias("b")).select("simple_name", "b.*"), "simple_name"), 5),
        ],
        "call_id",
    )


def resolve_methods(calls: DataFrame, symbols: DataFrame, compat: bool = False) -> DataFrame:
    """(call_id, usr, fqn) of calls (call_id, class_fqn, name, arguments): the method of the class with that name and as many parameters, else the first by qualified name.

    ``compat`` lets a name match any member whose qualified name has it after a
    dot, and gives empty signatures no count.
    """
    # equal questions are asked once; they are stored, so that the size they have decides how the methods they ask for are found
    question = ["class_fqn", "name", "arguments"]
    asked = stored(calls.select(*question).distinct(), "asked")
    # of methods that no question tells apart only the first can be an answer
    member, count = (F.lower("fqn"), arity_by_commas("signature")) if compat else (F.col("simple_name"), F.col("arity"))
    told = ["parent_fqn", "member", "count"]
    here = asked.select(F.col("class_fqn").alias("parent_fqn"), *([] if compat else [F.col("name").alias("member")]))
    members = with_keys(symbols).withColumns({"member": member, "count": count}).join(here, here.columns, "left_semi")
    methods = members.groupBy(*told).agg(F.min(F.struct("fqn", "usr")).alias("first")).select(*told, "first.*")
    named = F.contains("member", F.lower(F.concat(F.lit("."), "name"))) if compat else F.col("member") == F.col("name")
    pairs = asked.join(methods, (F.col("class_fqn") == F.col("parent_fqn")) & named)
    ranked = pairs.withColumn("prio", F.when(F.coalesce(F.col("count") == F.col("arguments"), F.lit(False)), 1).otherwise(2))
    answers = ranked.groupBy(*question).agg(F.min(F.struct("prio", "fqn", "usr")).alias("a")).select(*question, "a.*")
    same = (calls["class_fqn"] == answers["class_fqn"]) & (calls["name"] == answers["name"]) & calls["arguments"].eqNullSafe(answers["arguments"])
    return _best([calls.join(answers, same).select("call_id", "prio", F.lit(0).alias("pos"), "fqn", "usr")], "call_id")


def resolve_types(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """``names`` (type, package, imports) with fqn: a dotted name as it is; an explicit import; the first package import, the own package or java.lang that has it; else null.

    The imports are part of the question, so equal questions are asked once.
    """
    asked = names.select("type", "package", "imports").distinct().withColumn("__q", F.xxhash64("type", "package", "imports"))
    explicit = F.get(F.filter("imports", lambda i: F.endswith(i, F.concat(F.lit("."), F.col("type")))), F.lit(0))
    packages = F.concat(F.transform(F.filter("imports", lambda i: F.endswith(i, F.lit(".*"))), package_of), F.array("package", F.lit("java.lang")))
    open_ = asked.where(~F.contains("type", F.lit(".")) & explicit.isNull())
    options = open_.select("__q", "type", F.posexplode(packages).alias("pos", "pkg")).withColumn("fqn", F.when(F.length("pkg") > 0, F.concat_ws(".", "pkg", "type")).otherwise(F.col("type")))
    known = symbols.where(F.col("kind").isin("class", "interface")).select("fqn").distinct()
    found = options.join(known, "fqn").groupBy("__q").agg(F.min_by("fqn", "pos").alias("found"))
    answered = asked.join(found, "__q", "left").select("type", "package", "imports", F.when(F.contains("type", F.lit(".")), F.col("type")).otherwise(F.coalesce(explicit, "found")).alias("fqn"))
    same = [names[c].eqNullSafe(answered[c]) for c in ("type", "package", "imports")]
    return names.join(answered, same[0] & same[1] & same[2], "left").select(names["*"], answered["fqn"])


def resolve_calls(calls: DataFrame, symbols: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(call_id, target, resolved) of queued calls (schema CALL).

    Constructors look in the constructed type; calls without a qualifier or on
    ``this`` in the own class and then its ancestors, nearest first; on ``super``
    in the ancestors alone; other qualifiers are names of types first.  What
    nothing answers gets an unresolved target.  ``ancestors``: class_fqn,
    ancestor_fqn, dist.
    """
    calls = calls.withColumn("qualifier", F.when(F.length("qualifier") > 0, F.col("qualifier")))
    own = F.coalesce("is_constructor", F.lit(False))
    member = F.when(own, F.element_at(F.split("member", r"\."), -1)).otherwise(F.col("member"))
    base = calls.select("call_id", "class_fqn", "package", "imports", "qualifier", F.col("member").alias("written"), member.alias("name"), F.col("arguments_count").alias("arguments"), own.alias("constructs"))
    inside = base.where(~F.col("constructs") & (F.col("qualifier").isNull() | F.col("qualifier").isin("this", "super")))
    here = inside.where(F.coalesce(F.col("qualifier") != "super", F.lit(True))).select("call_id", "class_fqn", "name", "arguments", F.lit(0).alias("pos"))
    above = inside.join(ancestors, "class_fqn").select("call_id", F.col("ancestor_fqn").alias("class_fqn"), "name", "arguments", F.col("dist").alias("pos"))
    outside = base.where(F.col("constructs") | ~F.coalesce(F.col("qualifier").isin("this", "super"), F.lit(True))).withColumn("type", F.when(F.col("constructs"), F.col("written")).otherwise(F.col("qualifier")))
    typed = resolve_types(outside, symbols).where("fqn IS NOT NULL").select("call_id", F.col("fqn").alias("class_fqn"), "name", "arguments", F.lit(0).alias("pos"))
    lookups = union_all([here, above, typed])
    keyed = with_keys(symbols.where(F.col("kind").isin("method", "function", "constructor"))).select("parent_fqn", "simple_name", "arity", "fqn", "usr")
    pairs = lookups.join(keyed, (F.col("class_fqn") == F.col("parent_fqn")) & (F.col("name") == F.col("simple_name")))
    ranked = pairs.select("call_id", F.lit(1).alias("prio"), (F.col("pos") * 2 + F.when(F.col("arity") == F.col("arguments"), 0).otherwise(1)).alias("pos"), "fqn", "usr")
    whole = outside.where(~F.col("constructs")).select("call_id", F.concat_ws(".", "qualifier", "written").alias("full"))
    exact = whole.join(symbols.select("fqn", "usr"), F.substring_index("fqn", "(", 1) == F.col("full")).select("call_id", F.lit(3).alias("prio"), F.lit(0).alias("pos"), "fqn", "usr")
    best = _best([ranked, exact], "call_id")
    return calls.join(best, "call_id", "left").select("call_id", F.coalesce("usr", unresolved_usr("qualifier", "member")).alias("target"), F.col("usr").isNotNull().alias("resolved"))


def resolve_bases(queued: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call_id, usr, fqn) of queued base names: the class of that name in the first of the reference's scopes that has one."""
    asked = queued.select("call_id", "member", F.posexplode("imports").alias("pos", "scope"))
    named = asked.withColumn("fqn", F.concat_ws("::", F.when(F.length("scope") > 0, F.col("scope")), "member"))
    classes = symbols.where(F.col("kind").isin("class", "interface")).select("fqn", "usr")
    return _best([named.join(classes, "fqn").select("call_id", F.lit(1).alias("prio"), "pos", "fqn", "usr")], "call_id")


def resolve_scoped(queued: DataFrame, symbols: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(call_id, usr, fqn) of queued calls and overrides whose scopes (``imports``) are ordered.

    A call goes to a function of its name in the first scope that has one, or
    whose ancestors have one, nearest first; in one scope the number of
    parameters decides, then the qualified name.  An override looks in ancestors
    alone, for the same signature (``qualifier``).  ``ancestors``: class_fqn,
    ancestor_fqn, dist.
    """
    asked = queued.select("call_id", "kind", F.col("member").alias("simple_name"), "qualifier", F.col("arguments_count").alias("arguments"), F.posexplode("imports").alias("pos", "scope"))
    above = asked.join(ancestors.withColumnRenamed("class_fqn", "scope"), "scope").drop("scope").withColumnRenamed("ancestor_fqn", "scope")
    here = asked.where("kind <> 'CPP_OVERRIDES'").withColumn("dist", F.lit(0))
    functions = symbols.where(F.col("kind").isin("method", "function", "constructor")).select("fqn", "usr", "signature", scope_of("fqn").alias("scope"), simple_name("fqn").alias("simple_name"), cpp_arity("signature").alias("arity"))
    pairs = here.unionByName(above).join(functions, ["scope", "simple_name"])
    pairs = pairs.where((F.col("kind") != "CPP_OVERRIDES") | F.col("signature").eqNullSafe(F.col("qualifier")))
    misfit = F.when(F.col("arity") == F.col("arguments"), 0).otherwise(1)
    return _best([pairs.select("call_id", F.col("pos").alias("prio"), (F.col("dist") * 2 + misfit).alias("pos"), "fqn", "usr")], "call_id")
