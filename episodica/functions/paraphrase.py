"""Questions in other words: ordered rewriting rules and spelled numbers, as column functions.

A rule is a pattern and what it becomes, from the pattern's groups; of the rules of a question's task the first that matches is applied
to its first match, and a text that none matches stays as it is.  Where a rule has a choice of words, a hash of key and place chooses.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words.
ONES = tuple("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())
TENS = ("", "", *"twenty thirty forty fifty sixty seventy eighty ninety".split())
ORDINALS = tuple("zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split())
TENTHS = ("", "", *"twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth".split())
#: Words for the same thing.
PROJECT = ("workstream", "initiative", "effort", "codebase", "track")
WORKED = ("focused on", "spent time on", "busy with", "put hours into", "heads-down on")
AFTER = ("Right after", "Immediately following", "Straight after", "In the session after")
ARTIFACTS = {"migration plan": "migration write-up", "rollout checklist": "release checklist", "incident report": "postmortem writeup", "schema diff": "schema change", "load test": "stress test", "runbook": "ops guide"}
ACTIONS = {"drafted": "wrote up", "reviewed": "went through", "rewrote": "reworked", "signed off on": "approved", "rolled back": "reverted", "benchmarked": "profiled"}


def _of(words: Sequence[str], i: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), i.cast("int"))


def _spelled(n: Column, small: Sequence[str], round_: Sequence[str]) -> Column:
    tens, ones = F.floor(n / 10), n % 10
    whole = F.when(n < 20, _of(small, n)).when(ones == 0, _of(round_, tens)).otherwise(F.concat(_of(TENS, tens), F.lit("-"), _of(small, ones)))
    return F.when((n >= 0) & (n < 100), whole).otherwise(n.cast("string"))


def cardinal(n: Column) -> Column:
    """0 to 99 in words; other numbers in digits."""
    return _spelled(n, ONES, TENS)


def ordinal(n: Column) -> Column:
    """The place of 0 to 99 in words; other numbers in digits."""
    return _spelled(n, ORDINALS, TENTHS)


def choice(words: Sequence[str], key: Column, place: int) -> Column:
    """One of the words, by the first 32 bits of a hash of key and place."""
    h = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{place}"))), 1, 8), 16, 10).cast("long")
    return _of(words, F.pmod(h, F.lit(len(words))))


def synonym(word: Column, known: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.element_at(table, word), word)


_Rule = tuple[tuple[str, ...], str, Callable[[list[Column], Column], list]]
_RULES: tuple[_Rule, ...] = (
    (("episodic", "interference"), r"Which project did (\w+) work on in week (\d+) on (\w+)\?", lambda g, key: ["What ", choice(PROJECT, key, 0), " was ", g[0], " ", F.when(choice(("a", "b"), key, 1) == "a", choice(WORKED, key, 2)).otherwise("occupied with"), " on the ", g[2], " of their ", ordinal(g[1].cast("int")), " week?"]),
    (("episodic", "interference"), r"In week (\d+) on (\w+), which project did (\w+) (.+)\?", lambda g, key: ["On the ", g[1], " of their ", ordinal(g[0].cast("int")), " week, what did ", g[2], " ", synonym(g[3], ACTIONS), "?"]),
    (("abstraction",), r"Which project does (\w+) usually work on\?", lambda g, key: ["What does ", g[0], " spend most of their time on, generally speaking?"]),
    (("temporal",), r"What did (\w+) work on right after they (.+) the (\w+) (.+) in week (\d+)\?", lambda g, key: [choice(AFTER, key, 3), " ", g[0], " ", synonym(g[1], ACTIONS), " that ", g[2], " ", synonym(g[3], ARTIFACTS), " in their ", ordinal(g[4].cast("int")), " week, what came next for them?"]),
)


def paraphrased(text: Column, task: Column, key: Column) -> Column:
    """text in other words, by the rules of its task; key: what chooses among words (an id)."""
    out = None
    for tasks, pattern, made in _RULES:
        n = pattern.count("(")
        found = [F.regexp_extract(text, pattern, k + 1) for k in range(n)]
        before, after = F.regexp_extract(text, f"(?s)^(.*?){pattern}", 1), F.regexp_extract(text, f"(?s){pattern}(.*)$", n + 1)
        whole = F.concat(before, *[x if isinstance(x, Column) else F.lit(x) for x in made(found, key)], after)
        hit = task.isin(*tasks) & text.rlike(pattern)
        out = F.when(hit, whole) if out is None else out.when(hit, whole)
    return out.otherwise(text)
