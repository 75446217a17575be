"""Wordings for rendered messages, drawn by a hash of what they are for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed numbers of variants of each key; their wording is made by rule from the parts below.
VARIANTS = {
    "prompt_intro": 12, "section_problem": 12, "section_discussion": 12, "section_next": 10, "no_new_content": 8, "post_header": 10,
    "comment_header": 10, "vote_event": 10, "vote_new_text": 3, "vote_change_text": 3, "anonymous_voter": 12, "you_marker": 5,
}
_FRAMES = ("{}", "{}:", "[{}]", "- {}", "* {}", "({})", "= {} =", "> {}", "~ {}", "# {}", "| {} |", "<{}>")
_BODIES = {
    "prompt_intro": "You take part as {name}", "section_problem": "The problem", "section_discussion": "What was said so far", "section_next": "Write the next post",
    "no_new_content": "Nothing new since then", "post_header": "P_{local_id} by {author}{is_you}", "comment_header": "C_{local_id} on P_{local_post_id} by {author}{is_you}",
    "vote_event": "{author} on {target} {change}, now {cur}", "vote_new_text": "gave {value}", "vote_change_text": "went from {prev} to {value}",
    "anonymous_voter": "someone unnamed", "you_marker": " (you)",
}


def pool(key: str) -> list[str]:
    return [_FRAMES[k].format(_BODIES[key]) for k in range(VARIANTS[key])]


def hash_number(text: Column) -> Column:
    """The first 32 bits of the MD5 of a text: the same in every engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def pick(key: str, seed: Column, entry: Column | None = None, baseline: bool = False) -> Column:
    """A wording for (key, seed, entry): the same for the same three, independent between keys; baseline takes the first."""
    choices = pool(key)
    if baseline:
        return F.lit(choices[0])
    text = F.concat_ws(":", F.lit(f"template:{key}"), seed, *([entry] if entry is not None else []))
    return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(hash_number(text), F.lit(len(choices))) + 1).cast("int"))
