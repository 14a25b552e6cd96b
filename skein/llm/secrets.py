"""Operator 3: secrets in texts, by a trigram index that chooses the texts each rule reads."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as re_parser

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    """kind; a regular expression; the group and the least characters that make a match valid.

    run, if given, is a class whose maximal runs a match begins in, with `lead`, where only a run's first `lead` can begin a match: if
    that one fails, later ones fail for the same reason. They are not tried, as each would read the run again."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    run: str = ""
    lead: str = ""

    @property
    def once(self) -> str:
        """The expression that tries a run once; a match has what stands before `lead` in its run at its begin."""
        return f"(?<![{self.run}])(?>[{self.run}]*?(?={self.lead})){self.regex}" if self.run else self.regex


#: The three kinds every caller relies on, in their order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further public key formats that this operator reports beside the base kinds.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("github_pat", r"github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", run="A-Za-z0-9_-", lead="eyJ"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"https://hooks\.slack\.com/services/[A-Za-z0-9/]+"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("google_oauth", r"[0-9]+-[a-z0-9_]{32}\.apps\.googleusercontent\.com", run="0-9"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-AgEI[A-Za-z0-9_-]{50,}"),
    Rule("shopify", r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}"),
    Rule("digitalocean", r"do[opr]_v1_[a-f0-9]{64}"),
    Rule("square", r"sq0(?:csp|atp)-[A-Za-z0-9_-]{22,43}"),
    Rule("vault", r"hvs\.[A-Za-z0-9_-]{24,}"),
    Rule("mailchimp", r"[0-9a-f]{32}-us[0-9]{1,2}"),
)
RULES = BASE + MORE

#: Bounds of what is derived from an expression: strings of a run, members of a class, alternatives, trigrams of one.
STRINGS, MEMBERS, ALTERNATIVES, GRAMS = 64, 8, 64, 3

#: Characters with whether their case is folded.
_Run = tuple[tuple[str, bool], ...]


def _grams(run: _Run) -> frozenset[str] | None:
    """Trigrams that a text with this run must hold, GRAMS of them spread over it; None for a run too short for any."""
    found = []
    for i in range(len(run) - 2):
        part = run[i : i + 3]
        word = "".join(c for c, _ in part)
        found.append(f"i:{word.lower()}" if any(fold for _, fold in part) else f"c:{word}")
    if not found:
        return None
    n = min(GRAMS, len(found))
    return frozenset(found[i * (len(found) - 1) // max(n - 1, 1)] for i in range(n))


class _Derived:
    """What every match of a part of an expression needs: the strings it can be, as long as they are few,
    and alternatives of trigrams."""

    def __init__(self):
        self.runs: set[_Run] | None = {()}
        self.whole = True  # whether the runs are all that the part can be
        self.needs: list[frozenset[str]] | None = None  # no alternatives: nothing is needed

    def _also(self, alternatives: list[frozenset[str]] | None) -> None:
        if alternatives is None:
            return
        both = alternatives if self.needs is None else list({a | b for a in self.needs for b in alternatives})
        # too many: what is needed already and what is new each are enough
        self.needs = both if len(both) <= ALTERNATIVES else min(self.needs, alternatives, key=len)

    def cut(self) -> None:
        """What follows is anything: what the runs so far need is noted."""
        grams = [_grams(r) for r in self.runs]
        self._also(list(set(grams)) if grams and None not in grams else None)
        self.runs, self.whole = {()}, False

    def add(self, runs: set[_Run]) -> None:
        joined = {a + b for a in self.runs for b in runs}
        if len(joined) > STRINGS:
            self.cut()
            joined = runs
        self.runs = joined

    def then(self, part: _Derived) -> None:
        if part.whole:
            self.add(part.runs)
        else:
            self.cut()
            self._also(part.needs)


def _derive(parsed, fold: bool) -> _Derived:
    out = _Derived()
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out.add({((chr(arg), fold and chr(arg).isalpha()),)})
        elif name == "IN" and (members := _members(arg)) is not None:
            out.add({((c, fold and c.isalpha()),) for c in members})
        elif name == "SUBPATTERN":
            _, added, removed, inner = arg
            out.then(_closed(_derive(inner, (fold or bool(added & re.IGNORECASE)) and not removed & re.IGNORECASE)))
        elif name == "BRANCH":
            parts = [_closed(_derive(p, fold)) for p in arg[1]]
            if all(p.whole for p in parts) and sum(len(p.runs) for p in parts) <= STRINGS:
                out.add({r for p in parts for r in p.runs})
            else:
                out.cut()
                for p in parts:
                    p.cut()
                out._also(None if any(p.needs is None for p in parts) else list({a for p in parts for a in p.needs}))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            part = _closed(_derive(inner, fold))
            if part.whole and (least, most) == (0, 1) and any(len(r) < 3 for r in out.runs):
                out.add(part.runs | {()})
            elif part.whole and least == most <= 8:
                for _ in range(least):
                    out.add(part.runs)
            else:
                if least:
                    out.then(part)
                out.cut()
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue  # takes no characters
        else:
            out.cut()
    return out


def _closed(part: _Derived) -> _Derived:
    """A part that is not all runs, with the needs of its last runs noted."""
    if not part.whole:
        part.cut()
    return part


def _members(arg) -> list[str] | None:
    """The characters of a small class."""
    found: list[str] = []
    for op, x in arg:
        if str(op) == "LITERAL":
            found.append(chr(x))
        elif str(op) == "RANGE" and x[1] - x[0] < MEMBERS:
            found += map(chr, range(x[0], x[1] + 1))
        else:
            return None
    return found if len(found) <= MEMBERS else None


def trigram_query(rule: Rule) -> list[list[str]]:
    """The rule's Boolean query as alternatives of trigrams that must all be there; [] reads every text.

    Derived from the expression itself, as Cox ("Regular expression matching with a trigram index",
    2012) does: literals, small classes, alternations and optional parts are followed as the few
    strings they can be; what can be anything cuts those, and their trigrams are needed. The
    expression is parsed by Python's parser, which reads these as Spark does."""
    derived = _derive(re_parser.parse(rule.regex), False)
    derived.cut()
    return sorted(sorted(a) for a in derived.needs or [])


def _spans(text: Column, rule: Rule) -> Column:
    """(start, rank, kind, end) of the rule's matches, leftmost and non-overlapping, in code points."""
    # what lies between matches, and the matches: running lengths give the places
    gaps = F.transform(F.split(text, rule.once, -1), lambda x: F.length(x))
    match = F.regexp_extract_all(text, F.lit(rule.once), F.lit(0))
    valid = F.regexp_extract_all(text, F.lit(rule.once), F.lit(rule.group)) if rule.group else match
    before = lambda m: F.instr(m, rule.lead) - 1 if rule.lead else F.lit(0)
    rank = [r.kind for r in RULES].index(rule.kind) if rule in RULES else len(RULES)
    steps = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(match), F.lit(0))), F.transform(F.arrays_zip(match.alias("m"), valid.alias("v")), lambda p: F.struct(before(p["m"]).alias("b"), F.length(p["m"]).alias("m"), F.length(p["v"]).alias("v"))), lambda g, p: F.struct((g + p["b"]).alias("gap"), (p["m"] - p["b"]).alias("len"), p["v"].alias("valid")))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda a, s: F.struct(
            (a["at"] + s["gap"] + s["len"]).alias("at"),
            F.when(
                s["valid"] >= rule.least,
                F.concat(a["found"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (a["at"] + s["gap"] + s["len"]).alias("end")))),
            ).otherwise(a["found"]).alias("found"),
        ),
        lambda a: a["found"],
    )
    return F.when(text.rlike(rule.once), walked).otherwise(empty)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and found, an array of (start, rank, kind, end) for each row of docs.

    1. Index: of the trigrams that any rule's query names, each text posts those it holds:
       rows (trigram, row key). The index holds just the trigrams asked for, a fixed
       few, so a text posts at most that many rows however long it is.
    2. Query: for each alternative of a rule, postings are intersected by counting an
       alternative's trigrams for each row key (combined before the shuffle); a text with
       all of them is a candidate. Rules without a mandatory trigram need no postings.
    3. Verify: candidates meet the texts again by row key and the rule's expression runs on
       those alone; rules without trigrams run on every text.

    The row key is a hash of doc_id and text: repeated rows share a key and a result, and a
    clash of keys could only make one more text be read. All of it is built of Spark's own
    functions. Places are code points, the end is exclusive.

    Cases: null and empty texts have no spans; null doc_ids and repeated rows each
    give a row; other columns of docs are left aside; no rows give no rows.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.length("text")).alias("row_key"))
    queries = {rule.kind: trigram_query(rule) for rule in rules}
    grams = sorted({g for q in queries.values() for alternative in q for g in alternative})
    folded = F.lower("text")
    held = F.array_compact(F.array(*[F.when((folded if g[0] == "i" else F.col("text")).contains(g[2:]), F.lit(g)) for g in grams]))
    postings = keyed.select("row_key", F.explode(held).alias("gram"))
    # which alternatives a trigram serves: a fixed table of the rules
    serves: dict[str, list[str]] = {}
    needs: dict[str, int] = {}
    for kind, q in queries.items():
        for i, alternative in enumerate(q):
            needs[f"{kind}/{i}"] = len(alternative)
            for g in alternative:
                serves.setdefault(g, []).append(f"{kind}/{i}")
    served = F.create_map(*[x for g, a in serves.items() for x in (F.lit(g), F.array(*map(F.lit, a)))])
    needed = F.create_map(*[x for a, n in needs.items() for x in (F.lit(a), F.lit(n))])
    candidates = (
        postings.distinct()
        .groupBy("row_key")
        .agg(F.collect_list("gram").alias("grams"))  # at most the rules' trigrams
        .select("row_key", F.flatten(F.transform("grams", lambda g: served[g])).alias("hits"))
        .select("row_key", F.filter(F.array_distinct("hits"), lambda a: F.size(F.filter("hits", lambda h: h == a)) == needed[a]).alias("met"))
        .where(F.size("met") > 0)
        .select("row_key", F.transform("met", lambda a: F.substring_index(a, "/", 1)).alias("kinds"))
    )
    met = keyed.join(candidates, "row_key", "left")
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    found = [F.when(F.array_contains("kinds", r.kind), _spans(text, r)).otherwise(none) if queries[r.kind] else _spans(text, r) for r in rules]
    return met.select("doc_id", F.concat(*found).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, digests and text form of find_secrets()' spans."""
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(_joined(of(*[r.kind for r in BASE])), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )
