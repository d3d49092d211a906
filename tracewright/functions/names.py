"""One vocabulary for count columns that are named differently in different files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import read_settings

PREFIX = "Call_"
#: Names in a schema at most.
MOST_NAMES = 100_000

# Variants of a call by canonical name.
ALIASES = {
    "mmap": ["mmap2"],
    "fstat": ["fstat64"],
    "stat": ["stat64", "fstatat64", "statx"],
    "lstat": ["lstat64"],
    "lseek": ["_llseek"],
    "select": ["_newselect"],
    "fcntl": ["fcntl64"],
    "getdents": ["getdents64"],
    "truncate": ["truncate64"],
    "ftruncate": ["ftruncate64"],
    "sendfile": ["sendfile64"],
    "pread": ["pread64"],
    "pwrite": ["pwrite64"],
    "statfs": ["statfs64"],
    "prlimit": ["prlimit64"],
    "getrlimit": ["ugetrlimit"],
    "clock_gettime": ["clock_gettime64", "syscall_0x193"],
    "clock_nanosleep": ["clock_nanosleep_time64"],
    "getuid": ["getuid32"],
    "geteuid": ["geteuid32"],
    "getgid": ["getgid32"],
    "setuid": ["setuid32"],
    "setgid": ["setgid32"],
    "setresuid": ["setresuid32"],
    "chown": ["chown32"],
    "umount": ["umount2"],
    "epoll_wait": ["epoll_pwait"],
    "rt_sigreturn": ["sigreturn"],
    "open": ["openat"],
    "unlink": ["unlinkat"],
    "tkill": ["tgkill"],
    "set_thread_area": ["set_tls"],
}
# Names cut short in the source data.
FRAGMENTS = ["cloc", "fc", "g", "ge", "get", "getd", "gett", "getti", "gettime", "ioct", "na", "r", "re", "readlin", "rt_", "rt_si", "rt_sig", "rt_sigact", "s", "setso", "socke", "tim", "wri"]


@dataclass(frozen=True)
class NameRules:
    """Aliases by raw name, and fragments."""

    canonical_of: dict[str, str]
    fragments: frozenset[str]

    @classmethod
    def default(cls) -> NameRules:
        return cls({raw: name for name, raws in ALIASES.items() for raw in raws}, frozenset(FRAGMENTS))


    @classmethod
    def load(cls, path: str) -> NameRules:
        """Rules from a file: ``aliases`` (raw names by canonical name) and ``fragments``; a raw name stands once."""
        raw = read_settings(path)
        pairs = [(variant, name) for name, variants in (raw.get("aliases") or {}).items() for variant in variants]
        twice = sorted({v for v, _ in pairs if sum(v == w for w, _ in pairs) > 1})
        if twice or set(raw) - {"aliases", "fragments"}:
            raise ValueError(f"name rules: {twice} stand twice, {sorted(set(raw) - {'aliases', 'fragments'})} are unknown")
        return cls(dict(pairs), frozenset(raw.get("fragments") or ()))


def bare(column: str) -> str:
    return column.removeprefix(PREFIX)


def bare_name(column: Column) -> Column:
    return F.regexp_replace(column, f"^{PREFIX}", "")


def vocabulary(rules: NameRules, columns: list[str]) -> list[str]:
    """Sorted canonical names that the raw columns can fill."""
    return sorted({rules.canonical_of.get(n, n) for n in map(bare, columns) if n not in rules.fragments})


def resolution(names: DataFrame, rules: NameRules, column: str = "column") -> DataFrame:
    """column, canonical (or null), rule for each raw name; the vocabulary comes from the names themselves.

    Name tables are as large as schemas, which is checked, so the prefix match is a broadcast loop join.
    """
    if names.limit(MOST_NAMES + 1).count() > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names are no schema")
    spark = names.sparkSession
    aliases = spark.createDataFrame(list(rules.canonical_of.items()) or [("", "")], "raw string, alias string")
    fragments = spark.createDataFrame([(f,) for f in sorted(rules.fragments)], "fragment string")
    named = names.select(F.col(column).alias("column"), bare_name(F.col(column)).alias("name"))
    known = named.join(aliases, F.col("name") == F.col("raw"), "left").join(fragments, F.col("name") == F.col("fragment"), "left")
    words = known.where("fragment is null").select(F.coalesce("alias", "name").alias("word")).distinct()
    cut = known.where("fragment is not null").select("fragment").distinct()
    folded = cut.join(F.broadcast(words), F.expr("startswith(word, fragment)")).groupBy("fragment").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("only"))
    folded = folded.where("n = 1").select(F.col("fragment").alias("cut"), "only")
    out = known.join(folded, F.col("fragment") == F.col("cut"), "left")
    canonical = F.when(F.col("alias").isNotNull(), F.col("alias")).when(F.col("fragment").isNotNull(), F.col("only")).otherwise(F.col("name"))
    rule = F.when(F.col("alias").isNotNull(), "alias").when(F.col("fragment").isNull(), "identity").when(F.col("only").isNotNull(), "fragment-folded").otherwise("fragment-dropped")
    return out.select("column", canonical.alias("canonical"), rule.alias("rule"))


def resolve(rules: NameRules, column: str, words: list[str]) -> str | None:
    """The canonical name of one column of a schema, or None if it is dropped."""
    name = bare(column)
    if name in rules.canonical_of:
        return rules.canonical_of[name]
    if name not in rules.fragments:
        return name
    fitting = [w for w in words if w.startswith(name)]
    return fitting[0] if len(fitting) == 1 else None


def canonicalize(df: DataFrame, rules: NameRules, words: list[str], shared: tuple[str, ...] = ("Hash", "MalwareFamily", "Arch")) -> DataFrame:
    """Shared columns, then a short per vocabulary name: the sum of its source columns, 0 without any.

    One narrow projection; nulls count as 0, and sums are taken as ints before the cast.
    """
    sources: dict[str, list[str]] = {w: [] for w in words}
    for c in df.columns:
        if c.startswith(PREFIX) and (target := resolve(rules, c, words)) in sources:
            sources[target].append(c)

    def total(columns: list[str]) -> Column:
        out = F.lit(0)
        for c in columns:
            out = out + F.coalesce(F.col(f"`{c}`").cast("int"), F.lit(0))
        return out.cast("short")

    return df.select(*(c for c in shared if c in df.columns), *(total(cols).alias(w) for w, cols in sources.items()))


def inventory(spark: SparkSession, columns_of: dict[str, list[str]]) -> DataFrame:
    """column and a 0/1 column per file, over all column names of the files' schemas."""
    rows = [(c, d) for d, columns in columns_of.items() for c in columns if c.startswith(PREFIX)]
    return presence(spark.createDataFrame(rows, "column string, domain string"), "column", "domain", sorted(columns_of))


def presence(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A 0/1 matrix: which values of one column occur with each of another."""
    return df.groupBy(row).agg(*(F.max((F.col(column) == v).cast("int")).alias(v) for v in values))
