"""Scalar functions of the graph model, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symgraph.schema import FUNCTION_KINDS


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def synthetic_usr(fqn, file, line) -> Column:
    return F.concat(F.lit("java@"), F.substring(F.sha2(F.concat_ws("::", _c(fqn), _c(file), _c(line).cast("string")), 256), 1, 24))


def unresolved_usr(qualifier, member) -> Column:
    """The stand-in target of a call that nothing resolves."""
    q = _c(qualifier)
    return F.concat(F.lit("unresolved:"), F.when(F.length(q) > 0, q).otherwise(F.lit("this")), F.lit("."), _c(member))


def scope_tail(fqn) -> Column:
    """What follows the last ``::``."""
    return F.element_at(F.split(_c(fqn), "::"), -1)


def simple_name(fqn) -> Column:
    """What follows the last dot before the parameters, up to the parenthesis."""
    return F.substring_index(F.substring_index(F.substring_index(_c(fqn), "(", 1), ".", -1), "::", -1)


def dotted_name(fqn) -> Column:
    """What follows the very last dot, up to a parenthesis; dots in parameters count."""
    return F.substring_index(F.substring_index(_c(fqn), ".", -1), "(", 1)


def package_of(name) -> Column:
    """All before the last dot, or the name itself without one."""
    return F.regexp_replace(_c(name), r"\.[^.]*$", "")


def arity(signature) -> Column:
    """Parameters in a signature: 0 when blank."""
    s = _c(signature)
    return F.when(F.length(F.trim(s)) > 0, F.size(F.split(s, ","))).otherwise(F.lit(0))


def arity_by_commas(signature) -> Column:
    """Commas and one; null when blank, as a signature without text never counts."""
    s = _c(signature)
    return F.when(F.length(F.trim(s)) > 0, F.size(F.split(s, ",")))


def scope_of(fqn) -> Column:
    """What stands before the last ``::``, or ''."""
    return F.when(F.contains(_c(fqn), F.lit("::")), F.regexp_replace(_c(fqn), "::[^:]*$", "")).otherwise(F.lit(""))


def cpp_arity(signature) -> Column:
    """Parameters in a C++ signature: commas in template arguments and the const of a method do not count."""
    s = F.regexp_replace(F.coalesce(_c(signature), F.lit("")), r"(^| )const$", "")
    for _ in range(3):
        s = F.regexp_replace(s, r"<[^<>]*>|\([^()]*\)", "")
    return arity(s)


def signature_key(signature) -> Column:
    """A signature without white space; null when nothing is left."""
    s = F.regexp_replace(_c(signature), r"\s+", "")
    return F.when(F.length(s) > 0, s)


def signatures_agree(a, b) -> Column:
    """Equal without white space, or either of them empty."""
    return F.coalesce(signature_key(a) == signature_key(b), F.lit(True))


def namespace_or_global(namespace) -> Column:
    return F.coalesce(_c(namespace), F.lit("global"))


def contains_ci(text, part: str) -> Column:
    return F.contains(F.lower(_c(text)), F.lower(F.lit(part)))


def node_type(kind) -> Column:
    return F.when(_c(kind).isin(*FUNCTION_KINDS), "Function").otherwise("Class")


def element_id(src, rel, dst) -> Column:
    return F.concat_ws("-", _c(src), _c(rel), _c(dst))


def path_text(names) -> Column:
    return F.array_join(_c(names), " → ")


def short_number(n) -> Column:
    """1234 as 1.2K, 2500000 as 2.5M: the exact binary value of the quotient to one digit, its ties up."""
    n = _c(n)

    def scaled(unit: int, letter: str) -> Column:
        # format_number rounds the exact value with ties to even; the only ties are at a quarter, where it goes down, and at three quarters
        tie = (n % unit) == unit // 4
        return F.concat(F.when(tie, F.concat(F.floor(n / unit).cast("string"), F.lit(".3"))).otherwise(F.call_function("format_number", n / float(unit), F.lit("0.0"))), F.lit(letter))

    return F.when(n >= 1_000_000, scaled(1_000_000, "M")).when(n >= 1000, scaled(1000, "K")).otherwise(n.cast("string"))


def base_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"(\.[^./]+)$", 1))


def utc_now() -> Column:
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
