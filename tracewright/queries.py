"""The queries of the reference's operators, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .config import ModelConfig, SampleConfig, SplitConfig
from .fixtures import COUNTS, EVENT_TYPES, SCORED, SIGNED, STORE, TRACE, scored, store, table, trace
from .functions.features import add_signatures, featurize, inert, shares
from .functions.names import ALIASES, FRAGMENTS, NameRules, canonicalize, presence, resolution, vocabulary
from .operators import folds, metrics, model, positions, profiles, sampling, split, verify
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _signed(spark: SparkSession, d: str) -> DataFrame:
    return add_signatures(store(spark, d), COUNTS)


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# positions and runs


@query(f"WITH {TRACE} SELECT hash, event_id, position FROM trace")
def row_position(spark, d):
    return trace(spark, d).select("hash", "event_id", "position")


@query(f"""WITH {TRACE}, spread AS (SELECT *, unnest([5, 10, 15, 20]) AS prefix FROM trace),
  kept AS (SELECT *, row_number() OVER (PARTITION BY hash, prefix ORDER BY position DESC) AS rn FROM spread WHERE position <= prefix)
  SELECT prefix, hash, arch, family, call, event_id, position AS windows FROM kept WHERE rn = 1""")
def first_n_rows(spark, d):
    out = positions.first_rows(trace(spark, d), "hash", [5, 10, 15, 20])
    return out.select("prefix", "hash", "arch", "family", "call", "event_id", "windows")


_SLIDE = ", ".join(f"CAST(sum(CASE WHEN call = '{c}' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS \"{c}\"" for c in EVENT_TYPES)


@query(f"WITH {TRACE} SELECT hash, position, {_SLIDE} FROM trace WINDOW w AS (PARTITION BY hash ORDER BY position ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def sliding_window_20(spark, d):
    return positions.sliding_counts(trace(spark, d), "hash", "call", EVENT_TYPES, 20)


@query(f"""WITH {TRACE}, slid AS (SELECT hash, CAST(count(*) OVER (PARTITION BY hash ORDER BY position ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM trace)
  SELECT hash, CAST(count(*) AS BIGINT) AS windows, CAST(sum(n) AS BIGINT) AS mass, CAST(CASE WHEN count(*) <= 20 THEN count(*) * (count(*) + 1) // 2 ELSE 20 * count(*) - 190 END AS BIGINT) AS expected FROM slid GROUP BY hash""")
def trace_mass_check(spark, d):
    rows = trace(spark, d)
    slid = positions.sliding_counts(rows, "hash", "call", EVENT_TYPES, 20)
    mass = slid.groupBy("hash").agg(F.sum(sum((F.col(c) for c in EVENT_TYPES[1:]), F.col(EVENT_TYPES[0]))).alias("mass"))
    return positions.window_mass(rows, "hash", 20).join(mass, "hash").select("hash", "windows", "mass", "expected")


@query("""WITH r AS (SELECT user_id, lag(user_id) OVER (ORDER BY event_id) AS before FROM events)
  SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(count(DISTINCT user_id) AS BIGINT) AS distinct_keys, CAST(count(*) FILTER (before IS DISTINCT FROM user_id) AS BIGINT) AS runs,
  count(*) FILTER (before IS DISTINCT FROM user_id) = count(DISTINCT user_id) AS contiguous FROM r""")
def hash_runs_contiguity(spark, d):
    return positions.runs(table(spark, d, "events"), "user_id", "event_id", chunk=4096)


@query("""SELECT CAST(count(*) AS BIGINT) AS entities, CAST(min(n) AS BIGINT) AS least, CAST(median(n) AS DOUBLE) AS median, CAST(max(n) AS BIGINT) AS most FROM (SELECT count(*) AS n FROM events GROUP BY user_id)""")
def rows_per_entity_stats(spark, d):
    return profiles.rows_per_entity(table(spark, d, "events"), "user_id")


@query(f"WITH {TRACE} SELECT family, CAST(count(*) AS BIGINT) AS \"rows\" FROM trace GROUP BY family")
def class_counts(spark, d):
    return profiles.per_label(trace(spark, d), "family", "hash").select("family", "rows")


@query(f"WITH {TRACE} SELECT CAST(count(*) AS BIGINT) AS unknown_rows FROM trace WHERE lower(coalesce(family, '')) = 'unknown'")
def unknown_rows(spark, d):
    return profiles.unknown_rows(trace(spark, d), "family")


@query(f"WITH {TRACE} SELECT family, CAST(count(DISTINCT hash) AS BIGINT) AS entities FROM trace GROUP BY family")
def entities_per_class(spark, d):
    return profiles.per_label(trace(spark, d), "family", "hash").select("family", "entities")


@query("""WITH old AS (SELECT c_custkey AS key, CAST(0 AS BIGINT) AS n FROM customer), new AS (SELECT o_custkey AS key, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey)
  SELECT key, n FROM old WHERE key NOT IN (SELECT key FROM new) UNION ALL SELECT key, n FROM new""")
def upsert_state(spark, d):
    before = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit(0).cast("long").alias("n"))
    after = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return positions.upsert(before, after, "key")


# vocabulary

_NAMES = ["Call_mmap2", "Call_mmap", "Call_readlin", "Call_readlink", "Call_wri", "Call_write", "Call_writev", "Call_syscall_0x193", "Call_getti", "Call_gettimeofday", "Call_getuid32", "Call_s", "Call_socket", "Call_socke", "Call_open", "Call_openat", "Call_tim", "Call_ioct", "Call_ioctl", "Call_rt_sigact"]
_ALIAS_ROWS = ", ".join(f"('{raw}', '{name}')" for name, raws in ALIASES.items() for raw in raws)
_FRAGMENT_ROWS = ", ".join(f"('{f}')" for f in FRAGMENTS)
_NAME_ROWS = ", ".join(f"('{n}')" for n in _NAMES)


@query(f"""WITH names(col) AS (VALUES {_NAME_ROWS}), aliases(raw, alias) AS (VALUES {_ALIAS_ROWS}), frags(f) AS (VALUES {_FRAGMENT_ROWS}),
  k AS (SELECT col, replace(col, 'Call_', '') AS name, alias, f FROM names LEFT JOIN aliases ON replace(col, 'Call_', '') = raw LEFT JOIN frags ON replace(col, 'Call_', '') = f),
  words AS (SELECT DISTINCT coalesce(alias, name) AS w FROM k WHERE f IS NULL),
  folded AS (SELECT f, min(w) AS w FROM (SELECT DISTINCT f FROM k WHERE f IS NOT NULL) x JOIN words ON starts_with(w, f) GROUP BY f HAVING count(*) = 1)
  SELECT col AS "column", CASE WHEN alias IS NOT NULL THEN alias WHEN k.f IS NOT NULL THEN w ELSE name END AS canonical,
  CASE WHEN alias IS NOT NULL THEN 'alias' WHEN k.f IS NULL THEN 'identity' WHEN w IS NOT NULL THEN 'fragment-folded' ELSE 'fragment-dropped' END AS rule
  FROM k LEFT JOIN folded ON k.f = folded.f""")
def canonical_resolution(spark, d):
    return resolution(spark.createDataFrame([(n,) for n in _NAMES], "column string"), NameRules.default())


def _wide(spark, d):
    """Raw count columns under different names: views count under an alias, errors under a fragment."""
    c = F.col("call")
    as_int = lambda cond, kind: cond.cast("int").cast(kind)
    return trace(spark, d).select(F.col("hash").alias("Hash"), F.col("family").alias("MalwareFamily"), F.col("arch").alias("Arch"), "event_id", as_int(c == "view", "byte").alias("Call_mmap2"), as_int(c == "click", "double").alias("Call_mmap"), as_int(c == "error", "short").alias("Call_readlin"), as_int(c == "signup", "byte").alias("Call_readlink"), as_int(c == "purchase", "double").alias("Call_wri"))


@query(f"""WITH {TRACE} SELECT hash AS "Hash", family AS "MalwareFamily", arch AS "Arch", CAST(CASE WHEN call IN ('view', 'click') THEN 1 ELSE 0 END AS SMALLINT) AS mmap,
  CAST(CASE WHEN call IN ('error', 'signup') THEN 1 ELSE 0 END AS SMALLINT) AS readlink, CAST(0 AS SMALLINT) AS write, CAST(0 AS SMALLINT) AS writev FROM trace""")
def canonicalized_rows(spark, d):
    rules = NameRules.default()
    words = sorted({*vocabulary(rules, ["Call_mmap2", "Call_mmap", "Call_readlink"]), "write", "writev"})
    return canonicalize(_wide(spark, d), rules, words)


@query(f"""WITH {TRACE} SELECT call, {', '.join(f"CAST(max(CASE WHEN arch = '{a}' THEN 1 ELSE 0 END) AS INTEGER) AS {a}" for a in tables.DOMAINS)} FROM trace GROUP BY call""")
def column_inventory(spark, d):
    return presence(trace(spark, d), "call", "arch", tables.DOMAINS)


# profiles and duplicates


@query(f"WITH {STORE} SELECT * FROM store")
def entity_profile(spark, d):
    return store(spark, d)


@query(f"WITH {TRACE} SELECT hash, family, arch, CAST(count(*) AS BIGINT) AS windows, {', '.join(f'CAST(count(*) FILTER (call = {chr(39)}{c}{chr(39)}) AS BIGINT) AS {c!s}' for c in EVENT_TYPES)} FROM trace GROUP BY ALL")
def trace_profile(spark, d):
    rows = trace(spark, d).select("hash", "family", "arch", *((F.col("call") == c).cast("int").alias(c) for c in EVENT_TYPES))
    return profiles.profile(rows, ["hash", "family", "arch"], EVENT_TYPES)


@query(f"WITH {SIGNED} SELECT hash, exact, profile, presence FROM signed")
def signatures(spark, d):
    return _signed(spark, d).select("hash", "exact", "profile", "presence")


DUPLICATES = f"""WITH {SIGNED}, sizes AS (SELECT arch, family, exact, count(*) AS n FROM signed GROUP BY ALL), top AS (SELECT arch, family, max(n) AS largest FROM sizes GROUP BY ALL)
  SELECT s.arch, s.family, CAST(count(*) AS BIGINT) AS binaries, CAST(count(DISTINCT exact) AS BIGINT) AS unique_exact, CAST(count(DISTINCT profile) AS BIGINT) AS unique_profile,
  CAST(count(DISTINCT presence) AS BIGINT) AS unique_presence, CAST(any_value(largest) AS BIGINT) AS largest_exact FROM signed s JOIN top USING (arch, family) GROUP BY s.arch, s.family"""


@query(DUPLICATES)
def duplicate_report(spark, d):
    return profiles.duplicate_report(_signed(spark, d), "arch", "family")


def _cross(by: str) -> str:
    return f"""WITH {SIGNED}, long AS (UNPIVOT (SELECT arch, {by} AS side, exact, profile, presence FROM signed) ON exact, profile, presence INTO NAME kind VALUE signature),
  s AS (SELECT arch, kind, signature, count(DISTINCT side) AS n FROM long GROUP BY ALL)
  SELECT arch, kind, CAST(count(*) AS BIGINT) AS signatures, CAST(count(*) FILTER (n > 1) AS BIGINT) AS shared FROM s GROUP BY arch, kind"""


@query(_cross("family"))
def cross_class_report(spark, d):
    return profiles.cross_class_report(_signed(spark, d), "arch", "family")


@query(_cross("(family = '1-URGENT')"))
def cross_class_by_target(spark, d):
    return profiles.cross_class_report(_signed(spark, d).withColumn("target", F.col("family") == "1-URGENT"), "arch", "target")


_FIRST_COUNTS = ", ".join(f"CAST(count(*) FILTER (call = '{c}') AS VARCHAR)" for c in EVENT_TYPES)


@query(f"""WITH {TRACE}, spread AS (SELECT *, unnest([5, 10, 20]) AS prefix FROM trace),
  s AS (SELECT prefix, arch, hash, CASE WHEN family = 'Benign' THEN 'benign' ELSE 'malware' END AS side, concat_ws(',', {_FIRST_COUNTS}) AS exact FROM spread WHERE position <= prefix GROUP BY ALL),
  g AS (SELECT prefix, arch, exact, max(CASE WHEN side = 'benign' THEN 1 ELSE 0 END) AS b, max(CASE WHEN side = 'malware' THEN 1 ELSE 0 END) AS m FROM s GROUP BY ALL)
  SELECT prefix, arch, CAST(sum(b) AS BIGINT) AS benign, CAST(sum(m) AS BIGINT) AS malware, CAST(sum(b * m) AS BIGINT) AS shared FROM g GROUP BY prefix, arch""")
def first_window_shared(spark, d):
    slid = positions.sliding_counts(trace(spark, d), "hash", "call", EVENT_TYPES, 20)
    rows = slid.join(trace(spark, d).select("hash", "position", "arch", "family"), ["hash", "position"])
    first = positions.first_rows(rows, "hash", [5, 10, 20])
    signed = add_signatures(first.withColumn("side", F.when(F.col("family") == "Benign", "benign").otherwise("malware")), EVENT_TYPES)
    return profiles.shared_across({n: signed.where(F.col("prefix") == n) for n in (5, 10, 20)}, "arch", "side", ["benign", "malware"])


# splits

SPLIT = SplitConfig(inert_max_calls=3, inert_columns=("fr", "absent"), drop_labels=("5-LOW",), benign="1-URGENT")


def _assigned(key: str) -> str:
    """SQL of the deal, for groups of signatures or of single entities."""
    return f"""{SIGNED}, kept AS (SELECT *, windows < 3 AND fr = 0 AS inert, concat(arch, ':', {key}) AS grp FROM signed WHERE family <> '5-LOW'),
  sides AS (SELECT grp, count(DISTINCT family = '1-URGENT') > 1 AS conflict FROM kept WHERE NOT inert GROUP BY grp),
  dealers AS (SELECT grp, family AS deal_as FROM (SELECT grp, family, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, family) AS rn FROM kept GROUP BY grp, family) WHERE rn = 1),
  live AS (SELECT arch, deal_as, grp, count(*) AS n FROM kept JOIN dealers USING (grp) LEFT JOIN sides USING (grp) WHERE NOT inert AND NOT coalesce(conflict, false) GROUP BY ALL),
  placed AS (SELECT *, sum(n) OVER (PARTITION BY arch, deal_as) AS total, row_number() OVER (PARTITION BY arch, deal_as ORDER BY md5(concat_ws('/', '20260922', arch, deal_as, grp)), grp) AS rn FROM live),
  dealt AS (
    SELECT arch, deal_as, grp, rn, 'train' AS split, n AS tr, 0::HUGEINT AS va, 0::HUGEINT AS te FROM (SELECT arch, deal_as, grp, rn, n::HUGEINT AS n FROM placed) WHERE rn = 1
    UNION ALL
    SELECT arch, deal_as, grp, rn, split, tr + CASE WHEN split = 'train' THEN n ELSE 0 END, va + CASE WHEN split = 'val' THEN n ELSE 0 END, te + CASE WHEN split = 'test' THEN n ELSE 0 END FROM (
      SELECT p.arch, p.deal_as, p.grp, p.rn, p.n, q.tr, q.va, q.te,
        CASE WHEN q.tr / (0.7::DOUBLE * p.total) <= q.va / (0.1::DOUBLE * p.total) AND q.tr / (0.7::DOUBLE * p.total) <= q.te / (0.2::DOUBLE * p.total) THEN 'train'
             WHEN q.va / (0.1::DOUBLE * p.total) <= q.te / (0.2::DOUBLE * p.total) THEN 'val' ELSE 'test' END AS split
      FROM dealt q JOIN placed p ON p.arch = q.arch AND p.deal_as = q.deal_as AND p.rn = q.rn + 1)),
  assignment AS (SELECT hash, family, kept.arch, kept.grp AS "group", inert, CASE WHEN inert THEN 'inert' WHEN coalesce(conflict, false) THEN 'conflict' ELSE dealt.split END AS split
    FROM kept LEFT JOIN sides ON sides.grp = kept.grp LEFT JOIN dealt ON dealt.grp = kept.grp)"""


_BY_EXACT, _BY_HASH = _assigned("exact"), _assigned("hash")


def _assignment(spark, d, by: str = "exact"):
    return split.assign(_signed(spark, d), SplitConfig(**{**SPLIT.__dict__, "group_by": by}))


@query(f"WITH {STORE} SELECT hash, windows < 3 AND fr = 0 AS inert FROM store")
def inert_flag(spark, d):
    return store(spark, d).select("hash", inert(["fr", "absent"], 3, COUNTS).alias("inert"))


@query(f"""WITH RECURSIVE {_BY_EXACT} SELECT grp AS "group", coalesce(conflict, false) AS conflict FROM (SELECT DISTINCT grp FROM kept) LEFT JOIN sides USING (grp)""")
def conflict_groups(spark, d):
    return split.group_facts(split.marked(_signed(spark, d), SPLIT), SPLIT.benign).select("group", "conflict")


@query(f'WITH RECURSIVE {_BY_EXACT} SELECT grp AS "group", deal_as FROM dealers')
def group_majority_label(spark, d):
    return split.group_facts(split.marked(_signed(spark, d), SPLIT), SPLIT.benign).select("group", "deal_as")


@query(f"WITH RECURSIVE {_BY_EXACT} SELECT * FROM assignment")
def greedy_split(spark, d):
    return _assignment(spark, d)


@query(f"WITH RECURSIVE {_BY_HASH} SELECT * FROM assignment")
def greedy_split_by_entity(spark, d):
    return _assignment(spark, d, "hash")


@query(f"""WITH RECURSIVE {_BY_EXACT} SELECT arch, family, CAST(count(*) AS BIGINT) AS binaries, CAST(count(*) FILTER (inert) AS BIGINT) AS inert, CAST(count(*) FILTER (split = 'conflict') AS BIGINT) AS conflict,
  CAST(count(DISTINCT "group") FILTER (split IN ('train', 'val', 'test')) AS BIGINT) AS groups, CAST(count(*) FILTER (split = 'train') AS BIGINT) AS train, CAST(count(*) FILTER (split = 'val') AS BIGINT) AS val,
  CAST(count(*) FILTER (split = 'test') AS BIGINT) AS test FROM assignment GROUP BY arch, family""")
def split_summary(spark, d):
    return split.split_summary(_assignment(spark, d))


@query(f"""WITH RECURSIVE {_BY_EXACT}, dealt_rows AS (SELECT * FROM assignment WHERE split IN ('train', 'val', 'test')), g AS (SELECT arch, "group" FROM dealt_rows GROUP BY ALL HAVING count(DISTINCT split) > 1), h AS (SELECT arch, hash FROM dealt_rows GROUP BY ALL HAVING count(DISTINCT split) > 1)
  SELECT CAST((SELECT count(*) FROM g) + (SELECT count(*) FROM h) AS BIGINT) AS leaks""")
def split_leak_check(spark, d):
    return split.leaks(_assignment(spark, d)).agg(F.count(F.lit(1)).alias("leaks"))


def _live(spark, d):
    return split.live_entities(store(spark, d), _assignment(spark, d), SPLIT.benign)


_LIVE = f"""{_BY_EXACT}, entities AS (SELECT s.hash, s.arch, s.family, s.windows, {', '.join(f's.{c}' for c in COUNTS)}, a."group", a.split, s.family <> '1-URGENT' AS is_malware
  FROM store s JOIN assignment a ON a.hash = s.hash AND a.arch = s.arch WHERE a.split IN ('train', 'val', 'test'))"""


@query(f"WITH RECURSIVE {_LIVE} SELECT * FROM entities")
def live_entities(spark, d):
    return _live(spark, d)


@query(f"""WITH RECURSIVE {_LIVE} SELECT hash, arch, 'in-architecture' AS experiment, arch AS held_out, split AS role FROM entities""")
def in_arch_folds(spark, d):
    return folds.in_domain(_live(spark, d)).select("hash", "arch", "experiment", "held_out", "role")


@query(f"""WITH RECURSIVE {_LIVE} SELECT hash, l.arch, 'leave-one-architecture-out' AS experiment, held_out, CASE WHEN l.arch = held_out THEN 'test' ELSE split END AS role
  FROM entities l, (SELECT DISTINCT arch AS held_out FROM entities) h WHERE l.arch = held_out OR split IN ('train', 'val')""")
def leave_one_out_folds(spark, d):
    return folds.leave_one_out(_live(spark, d)).select("hash", "arch", "experiment", "held_out", "role")


# features

_SUM = " + ".join(COUNTS)


@query(f"""WITH {STORE} SELECT hash, {', '.join(f'round(CASE WHEN {_SUM} > 0 THEN {c} / CAST({_SUM} AS DOUBLE) ELSE 0 END, 6) AS {c}' for c in COUNTS)}, round(ln(1 + CAST(windows AS DOUBLE)), 6) AS log_length FROM store""")
def profile_features(spark, d):
    return _rounded(featurize(store(spark, d), COUNTS, "profile").select("hash", *COUNTS, "log_length"), 6)


@query(f"WITH {STORE} SELECT hash, {', '.join(f'round(ln(1 + CAST({c} AS DOUBLE)), 6) AS {c}' for c in COUNTS)} FROM store")
def log_count_features(spark, d):
    return _rounded(featurize(store(spark, d), COUNTS, "log_counts").select("hash", *COUNTS), 6)


@query(f"""WITH {TRACE}, slid AS (SELECT hash, position, {_SLIDE} FROM trace WINDOW w AS (PARTITION BY hash ORDER BY position ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
  SELECT hash, position, {', '.join(f'round("{c}" / CAST(least(position, 20) AS DOUBLE), 6) AS "{c}"' for c in EVENT_TYPES)} FROM slid""")
def window_features(spark, d):
    slid = positions.sliding_counts(trace(spark, d), "hash", "call", EVENT_TYPES, 20)
    return _rounded(slid.select("hash", "position", *shares(EVENT_TYPES)), 6)


# draws

SAMPLE = SampleConfig(units={"mid": 21, "all": 1}, cap=8, sensitivity_cap=4, seeds=(0, 1))
_PLAN = f"""{TRACE}, ents AS (SELECT hash, arch, count(*) AS windows FROM trace GROUP BY ALL), u(unit, first) AS (VALUES ('mid', 21), ('all', 1)), s(seed) AS (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))),
  cand AS (SELECT t.hash, t.arch, unit, seed, t.position, row_number() OVER (PARTITION BY t.hash, t.arch, unit, seed ORDER BY md5(concat_ws('/', CAST(seed AS VARCHAR), t.arch, t.hash, unit, CAST(t.position AS VARCHAR))), t.position) AS rank FROM trace t, u, s WHERE t.position >= u.first),
  plan AS (SELECT hash, arch, unit, seed, position, CAST(rank AS BIGINT) AS rank FROM cand WHERE rank <= 8)"""


def _plan(spark, d):
    entities = trace(spark, d).groupBy("hash", "arch").agg(F.count(F.lit(1)).alias("windows"))
    return sampling.plan_sample(entities, SAMPLE)


@query(f"WITH {_PLAN} SELECT * FROM plan")
def sample_plan(spark, d):
    return _plan(spark, d).select("hash", "arch", "unit", "seed", "position", "rank")


@query(f"WITH {_PLAN} SELECT t.hash, t.position, t.call FROM trace t JOIN plan p ON p.hash = t.hash AND p.position = t.position AND p.arch = t.arch WHERE unit = 'mid' AND seed = 1 AND rank <= 4")
def draw_rows(spark, d):
    plan = _plan(spark, d)
    return sampling.draw(sampling.sample_rows(trace(spark, d), plan), plan, "mid", 1, 4).select("hash", "position", "call")


@query(f"WITH {_PLAN} SELECT hash, position, call FROM trace t WHERE EXISTS (SELECT 1 FROM plan p WHERE p.hash = t.hash AND p.position = t.position)")
def sample_semi_join(spark, d):
    return sampling.sample_rows(trace(spark, d), _plan(spark, d)).select("hash", "position", "call")


_SIDES = """CASE WHEN md5({k}) < 'b3333333333333333333333333333333' THEN 'train' WHEN md5({k}) < 'cccccccccccccccccccccccccccccccc' THEN 'val' ELSE 'test' END"""


@query(f"""WITH {_PLAN}, live AS (SELECT DISTINCT hash, arch, {_SIDES.format(k="concat('b/', arch, ':', family)")} AS behaviour_grouped, {_SIDES.format(k="concat('h/', hash)")} AS hash_grouped FROM trace WHERE family <> 'Unknown')
  SELECT p.hash, p.position, behaviour_grouped, hash_grouped, {_SIDES.format(k="concat_ws('/', '0', 'row-random', p.hash, CAST(p.position AS VARCHAR))")} AS row_random
  FROM plan p JOIN live USING (hash, arch) WHERE unit = 'all' AND seed = 0""")
def three_way_split(spark, d):
    rows, plan = trace(spark, d), _plan(spark, d)
    side = lambda k: F.when(F.md5(k) < "b" + "3" * 31, "train").when(F.md5(k) < "c" * 32, "val").otherwise("test")
    ents = rows.where("family <> 'Unknown'").select("hash", "arch", "family").distinct()
    behaviour = ents.select("hash", "arch", F.concat_ws(":", "arch", "family").alias("group"), side(F.concat(F.lit("b/"), "arch", F.lit(":"), "family")).alias("split"))
    by_hash = ents.select("hash", "arch", side(F.concat(F.lit("h/"), "hash")).alias("split"))
    drawn = sampling.draw(sampling.sample_rows(rows, plan), plan, "all", 0, SAMPLE.cap)
    return sampling.three_way(drawn, behaviour, by_hash, 0, SPLIT.fractions).select("hash", "position", "behaviour_grouped", "hash_grouped", "row_random")


# metrics

_MCC = "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END"


@query(f"""WITH {SCORED}, v AS (SELECT arch, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY ALL),
  c AS (SELECT arch, score, CAST(sum(pos) OVER w AS DOUBLE) AS fn, CAST(sum(neg) OVER w AS DOUBLE) AS tn, sum(pos) OVER (PARTITION BY arch) AS ap, sum(neg) OVER (PARTITION BY arch) AS an, lead(score) OVER (PARTITION BY arch ORDER BY score) AS nxt FROM v WINDOW w AS (PARTITION BY arch ORDER BY score)),
  m AS (SELECT arch, (score + nxt) / 2 AS cut, fn, tn, CAST(ap AS DOUBLE) - fn AS tp, CAST(an AS DOUBLE) - tn AS fp FROM c WHERE nxt IS NOT NULL AND ap > 0 AND an > 0),
  q AS (SELECT arch, cut, {_MCC} AS q FROM m), b AS (SELECT arch, max(q) AS best FROM q GROUP BY arch),
  r AS (SELECT q.arch, cut, row_number() OVER (PARTITION BY q.arch ORDER BY abs(cut - 0.5::DOUBLE), cut) AS rn FROM q JOIN b USING (arch) WHERE abs(q - best) <= 1e-8 + 1e-5 * abs(best))
  SELECT a.arch, round(coalesce(cut, 0.5::DOUBLE), 9) AS threshold FROM (SELECT DISTINCT arch FROM scored) a LEFT JOIN r ON r.arch = a.arch AND rn = 1""")
def choose_threshold(spark, d):
    return _rounded(metrics.choose_threshold(scored(spark, d), ["arch"]))


@query(f"""WITH {SCORED}, c AS (SELECT arch, CAST(count(*) FILTER (y = 1 AND score >= 0.6::DOUBLE) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND score >= 0.6::DOUBLE) AS DOUBLE) AS fp, CAST(count(*) FILTER (y = 1 AND score < 0.6::DOUBLE) AS DOUBLE) AS fn, CAST(count(*) FILTER (y = 0 AND score < 0.6::DOUBLE) AS DOUBLE) AS tn,
    CAST(count(*) FILTER (y = 1 AND score >= 0.5::DOUBLE) AS DOUBLE) AS htp, CAST(count(*) FILTER (y = 0 AND score >= 0.5::DOUBLE) AS DOUBLE) AS hfp, CAST(count(*) FILTER (y = 1 AND score < 0.5::DOUBLE) AS DOUBLE) AS hfn, CAST(count(*) FILTER (y = 0 AND score < 0.5::DOUBLE) AS DOUBLE) AS htn FROM scored GROUP BY arch),
  f AS (SELECT *, tp + fp + fn + tn AS n, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) END AS f0 FROM c)
  SELECT arch, CAST(n AS BIGINT) AS n, round(greatest((tp + fn) / n, (fp + tn) / n), 9) AS chance, round((tp + tn) / n, 9) AS accuracy, round((coalesce(f1, 0) + coalesce(f0, 0)) / ((f1 IS NOT NULL)::INT + (f0 IS NOT NULL)::INT), 9) AS macro_f1,
  round({_MCC}, 9) AS mcc, round({_MCC.replace('tp', 'htp').replace('fp', 'hfp').replace('fn', 'hfn').replace('tn', 'htn')}, 9) AS mcc_half FROM f""")
def binary_metrics(spark, d):
    return _rounded(metrics.binary_metrics(scored(spark, d), ["arch"], F.lit(0.6)))


@query(f"""WITH {SCORED}, r AS (SELECT arch, y, avg(rn) OVER (PARTITION BY arch, score) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY arch ORDER BY score) AS rn FROM scored)),
  s AS (SELECT arch, sum(rank) FILTER (y = 1) AS ranks, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS n FROM r GROUP BY arch)
  SELECT arch, CASE WHEN p > 0 AND n > 0 THEN round((ranks - p * (p + 1) / 2) / (p * n), 9) END AS auroc FROM s""")
def auroc(spark, d):
    return _rounded(metrics.auroc(scored(spark, d), ["arch"]))


@query(f"WITH {SCORED} SELECT grp, arg_min(y, doc_id) AS y, round(avg(score), 9) AS score, CAST(count(*) AS BIGINT) AS members FROM scored GROUP BY grp")
def group_collapse(spark, d):
    return _rounded(metrics.collapse(scored(spark, d), ["grp"], "doc_id"))


_GUESS = "CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE arch END"


@query(f"""WITH {SCORED}, g AS (SELECT arch AS t, {_GUESS} AS p FROM scored), k AS (SELECT DISTINCT t AS k FROM g UNION SELECT DISTINCT p FROM g),
  s AS (SELECT k, CAST((SELECT count(*) FROM g WHERE t = k) AS DOUBLE) AS t, CAST((SELECT count(*) FROM g WHERE p = k) AS DOUBLE) AS p, CAST((SELECT count(*) FROM g WHERE p = k AND t = k) AS DOUBLE) AS c FROM k),
  a AS (SELECT sum(t) AS n, sum(c) AS c, sum(t * p) AS tp, sum(t * t) AS tt, sum(p * p) AS pp, max(t) AS top, avg(2 * c / (t + p)) AS macro FROM s)
  SELECT CAST(n AS BIGINT) AS n, round(c / n, 9) AS accuracy, round(top / n, 9) AS chance, round(macro, 9) AS macro_f1, round((c * n - tp) / sqrt((n * n - pp) * (n * n - tt)), 9) AS mcc FROM a""")
def multiclass_metrics(spark, d):
    guess = F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("arch"))
    return _rounded(metrics.multiclass_metrics(scored(spark, d).withColumn("guess", guess), "arch", "guess"))


def _results(spark, d):
    """Results of two runs over the same folds: plain, and with shifted scores."""
    s = scored(spark, d)
    plain = metrics.binary_metrics(s, ["arch"], F.lit(0.6)).withColumn("experiment", F.lit("in-architecture"))
    other = metrics.binary_metrics(s.withColumn("score", F.col("score") * 0.9), ["arch"], F.lit(0.6)).withColumn("experiment", F.lit("first-20 in-architecture"))
    return plain.unionByName(other).select("experiment", F.col("arch").alias("held_out"), F.lit("binary").alias("view"), F.col("n").alias("test_n"), "mcc")


_CONF = "CAST(count(*) FILTER (y = 1 AND {s} >= 0.6::DOUBLE) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND {s} >= 0.6::DOUBLE) AS DOUBLE) AS fp, CAST(count(*) FILTER (y = 1 AND {s} < 0.6::DOUBLE) AS DOUBLE) AS fn, CAST(count(*) FILTER (y = 0 AND {s} < 0.6::DOUBLE) AS DOUBLE) AS tn"


@query(f"""WITH {SCORED}, a AS (SELECT arch, count(*) AS n, {_CONF.format(s='score')} FROM scored GROUP BY arch), b AS (SELECT arch, {_CONF.format(s='score * 0.9::DOUBLE')} FROM scored GROUP BY arch)
  SELECT 'in-architecture' AS experiment, x.arch AS held_out, 'binary' AS view, CAST(x.n AS BIGINT) AS test_n, round(x.m, 9) AS whole, round(z.m, 9) AS "first-20" FROM (SELECT arch, n, {_MCC} AS m FROM a) x JOIN (SELECT arch, {_MCC} AS m FROM b) z USING (arch)""")
def run_comparison(spark, d):
    return _rounded(folds.compare(_results(spark, d), ["first-20"]))


_DRAWS = """SELECT 'mid' AS unit, 100 AS cap, seed, arch, kind AS split, 'binary' AS view, avg(score) * (1 - m * 0.125::DOUBLE) + seed * 0.01::DOUBLE AS mcc, max(score) AS auroc FROM scored, (VALUES (0), (1), (2)) s(seed), (VALUES ('row_random', 0), ('hash_grouped', 1), ('behaviour_grouped', 2)) k(kind, m) GROUP BY seed, arch, kind, m"""


@query(f"""WITH {SCORED}, r AS ({_DRAWS}) SELECT unit, cap, arch, view, {', '.join(f"round(avg(mcc) FILTER (split = '{k}'), 9) AS mcc_{k}, round(min(mcc) FILTER (split = '{k}'), 9) AS mcc_min_{k}, round(max(mcc) FILTER (split = '{k}'), 9) AS mcc_max_{k}, round(avg(auroc) FILTER (split = '{k}'), 9) AS auroc_{k}" for k in ('row_random', 'hash_grouped', 'behaviour_grouped'))},
  CAST(least(count(*) FILTER (split = 'row_random'), count(*) FILTER (split = 'hash_grouped'), count(*) FILTER (split = 'behaviour_grouped')) AS BIGINT) AS seeds,
  round(avg(mcc) FILTER (split = 'row_random') - avg(mcc) FILTER (split = 'hash_grouped'), 9) AS row_gap, round(avg(mcc) FILTER (split = 'hash_grouped') - avg(mcc) FILTER (split = 'behaviour_grouped'), 9) AS identity_gap FROM r GROUP BY unit, cap, arch, view""")
def leakage_summary(spark, d):
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(m).alias("m")) for m, k in enumerate(("row_random", "hash_grouped", "behaviour_grouped")))))
    rows = scored(spark, d).withColumn("k", kinds).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    results = rows.groupBy("seed", "arch", F.col("k.kind").alias("split")).agg((F.avg("score") * (1 - F.first("k.m") * F.lit(0.125)) + F.first("seed") * F.lit(0.01)).alias("mcc"), F.max("score").alias("auroc"))
    return _rounded(folds.summarize(results.withColumn("unit", F.lit("mid")).withColumn("cap", F.lit(100)).withColumn("view", F.lit("binary"))))


# files


@query("""WITH f AS (SELECT lower(n_name) AS arch, 'strace' AS modality, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 15 GROUP BY ALL), p AS (SELECT lower(n_name) AS arch, 'strace' AS modality, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey > 5 GROUP BY ALL)
  SELECT arch, modality, CAST(f.n AS BIGINT) AS rows_in_file, CAST(p.n AS BIGINT) AS rows_in_paper, CAST(f.n - p.n AS BIGINT) AS unknown_rows FROM f FULL JOIN p USING (arch, modality)""")
def outer_count_compare(spark, d):
    nation = table(spark, d, "nation")
    c = table(spark, d, "customer").join(F.broadcast(nation.where("n_nationkey < 15")), F.expr("c_nationkey = n_nationkey"))
    s = table(spark, d, "supplier").join(F.broadcast(nation.where("n_nationkey > 5")), F.expr("s_nationkey = n_nationkey"))
    files = c.groupBy(F.lower("n_name").alias("arch")).agg(F.count(F.lit(1)).alias("rows")).withColumn("modality", F.lit("strace"))
    paper = s.groupBy(F.col("n_name").alias("Architecture")).agg(F.count(F.lit(1)).alias("count")).withColumn("DataType", F.lit("strace"))
    return tables.compare_counts(files, tables.paper_totals(paper))


@query("""WITH t AS (SELECT l_quantity, l_discount, l_tax, CASE WHEN l_linenumber = 7 THEN 0.37::DOUBLE ELSE l_quantity END AS filled FROM lineitem),
  long AS (UNPIVOT t ON l_quantity, l_discount, l_tax, filled INTO NAME col VALUE v), c AS (SELECT col, v, count(*) AS n FROM long WHERE v % 1 <> 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rn FROM c)
  SELECT col AS "column", CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS rows_sampled, CAST(sum(n) AS BIGINT) AS non_integer_rows, CAST(count(*) AS BIGINT) AS distinct_non_integer, max(v) FILTER (rn = 1) AS top_value, CAST(max(n) FILTER (rn = 1) AS BIGINT) AS top_value_rows FROM r GROUP BY col""")
def fill_check(spark, d):
    lines = table(spark, d, "lineitem").withColumn("filled", F.when(F.col("l_linenumber") == 7, F.lit(0.37)).otherwise(F.col("l_quantity")))
    return verify.fill_check(lines, ["l_quantity", "l_discount", "l_tax", "filled"])


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS tax FROM lineitem)
  SELECT l_linenumber, CAST(count(*) AS BIGINT) AS n, round(sum(coalesce(tax, m)), 4) AS filled FROM t, (SELECT avg(tax) AS m FROM t) GROUP BY l_linenumber""")
def mean_fill_contrast(spark, d):
    lines = table(spark, d, "lineitem").select("l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("tax"))
    return profiles.mean_filled(lines, ["tax"]).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("tax"), 4).alias("filled"))


_PATHS = ["data/mips/mips/Parquet Format/strace.parquet", "data/ARMS/x/pcap.parquet", "raw/mipsel/Sar.parquet", "raw/xmips/strace.parquet", "x86/other.parquet", "strace.tar", "arm/mips/strace.parquet"]
_PATH_ROWS = ", ".join(f"('{p}')" for p in _PATHS)


@query(f"""WITH paths(path) AS (VALUES {_PATH_ROWS}), parts AS (SELECT path, list_transform(string_split(lower(path), '/'), lambda p: CASE WHEN p = 'arms' THEN 'arm' ELSE p END) AS ps FROM paths),
  s AS (SELECT path, list_filter(ps, lambda p: p IN ('arm', 'mips', 'mipsel', 'x86')) AS a, regexp_replace(ps[-1], '(.)[.][^.]*$', '\\1') AS stem FROM parts)
  SELECT path, a[1] AS arch, CASE WHEN stem IN ('strace', 'pcap', 'sar') THEN stem END AS modality FROM s""")
def path_classify(spark, d):
    paths = spark.createDataFrame([(p,) for p in _PATHS], "path string")
    return paths.select("path", tables.domain_of(F.col("path")).alias("arch"), tables.modality_of(F.col("path")).alias("modality"))


@query()
def parquet_manifest(spark, d):
    return tables.manifest(spark, d)


@query()
def null_columns(spark, d):
    facts = tables.footers(tables.list_parquet(spark, d))
    return facts.select("path", F.explode_outer("null_columns").alias("column"))


@query()
def table_report(spark, d):
    e = table(spark, d, "events")
    return verify.report(e, "user_id", "event_type", "event_id", ["value"]).select(F.to_json(F.struct("*")).alias("report"))


# models

_MODEL = ModelConfig()


@query()
def gbt_in_arch(spark, d):
    return model.score_folds(folds.in_domain(model.assembled(_live(spark, d), COUNTS, _MODEL)), _MODEL)


@query()
def gbt_leave_one_out(spark, d):
    return model.score_folds(folds.leave_one_out(model.assembled(_live(spark, d), COUNTS, _MODEL)), _MODEL)


@query()
def arch_sanity(spark, d):
    return model.domain_sanity(_live(spark, d), COUNTS, _MODEL)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_report(spark, d)


__all__ = ["QUERIES", "ORACLE", "flagship", "fixtures"]
