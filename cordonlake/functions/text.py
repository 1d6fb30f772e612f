"""Text as columns: words, checksums, shingles, headings, injected instructions, fences. All built from JVM functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that lexical search leaves out.
STOPWORDS = [
    "the", "and", "for", "that", "this", "with", "from", "not", "any", "all", "shall", "will", "may", "such", "which", "has",
    "have", "had", "was", "were", "are", "our", "its", "his", "her", "their", "been", "other", "under", "into", "upon", "than",
    "then", "there", "these", "those", "each", "also", "including",
]


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; inside inner functions it would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column, longer_than: int = 2) -> Column:
    """Runs of a-z and 0-9 after lower-casing that are longer than ``longer_than``; null gives null."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) > longer_than)


def search_terms(text: Column) -> Column:
    """Words without stopwords, repetitions kept."""
    return F.filter(words(text), lambda w: ~w.isin(STOPWORDS))


def run_lengths(items: Column) -> Column:
    """``array<struct<item, n>>``: the distinct items of an array and how often each occurs, in order of the items."""

    def count(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return bound(first, lambda at: F.transform(at, lambda p, k: F.struct(F.get(s, p).alias("item"), (F.coalesce(F.get(at, k + 1), F.size(s)) - p).alias("n"))))

    return bound(F.array_sort(items), count)


def plain(text: Column) -> Column:
    """Lower case, anything but letters a-z, digits and white space to spaces, spaces collapsed.

    Compatibility forms (full-width letters, ligatures) are not folded first; Spark has no function for it.
    """
    # The two steps decide which checksums are equal.
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]+", " "), r"\s+", " "))


def checksum(text: Column) -> Column:
    """SHA-256 of :func:`plain`, equal for texts that differ in layout and case only."""
    return F.sha2(plain(text), 256)


def collapsed(text: Column) -> Column:
    """White space collapsed and trimmed, lower case: the form in which quotes are compared."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def sampled_shingles(text: Column, n: int = 5, digit: str | None = "0") -> Column:
    """MD5 of the distinct sequences of ``n`` words whose first hexadecimal digit is ``digit``: one in sixteen; all without one."""
    every = bound(F.split(plain(text), " "), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.md5(F.concat_ws(" ", F.slice(w, i, n))))))
    return F.array_distinct(F.filter(every, lambda h: F.substring(h, 1, 1) == digit) if digit else every)


def slug(text: Column, longest: int = 60) -> Column:
    """Lower case, other characters to single dashes, cut; ``unnamed`` where nothing is left."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, longest)
    return F.coalesce(F.when(s != "", s), F.lit("unnamed"))


def partition_name(tenant: Column) -> Column:
    """Name of a tenant's partition: ``chunk_`` and the tenant in lower case, other characters to underscores."""
    return F.concat(F.lit("chunk_"), F.regexp_replace(F.lower(tenant), "[^a-z0-9]+", "_"))


def heading(line: Column, longest: int = 120, label: int = 80) -> Column:
    """The label of a heading line: its number and title, 80 characters at most; null for other lines.

    A heading has fewer than ``longest`` characters and begins with a dotted number and a title of up to 71 characters, or
    with the word article or section, its number (Roman or not; dotted for sections) and a title of up to 60.
    """

    def parts(t: Column) -> Column:
        first, rest = F.substring_index(t, " ", 1), F.ltrim(F.regexp_replace(F.substring(t, F.length(F.substring_index(t, " ", 1)) + 1, F.lit(longest)), r"^\s+", ""))
        number = F.regexp_replace(first, r"\.$", "")
        numbered = F.when(number.rlike(r"^\d+(\.\d+)*$") & F.length(rest).between(1, 71), F.concat(number, F.lit(" "), F.rtrim(rest)))
        kind = F.upper(first)
        own = F.when(kind == "ARTICLE", F.regexp_extract(rest, "^(?i)[ivxlc0-9]+", 0)).when(kind == "SECTION", F.regexp_extract(rest, r"^\d+(\.\d+)*", 0))
        after = F.substring(rest, F.length(own) + 1, F.lit(longest))
        title = F.regexp_replace(after, r"^[.\-—:]?\s*", "")
        worded = F.when((own != "") & ~after.rlike(r"^\w") & (F.length(title) <= 60), F.trim(F.concat(first, F.lit(" "), own, F.lit(" "), F.trim(title))))
        return F.when(F.length(t) < longest, F.substring(F.coalesce(numbered, worded), 1, label))

    # white space between words counts as one space
    return bound(F.trim(F.regexp_replace(line, r"\s+", " ")), parts)


def starts_mid_sentence(before: Column) -> Column:
    """Whether text that follows ``before`` begins within a sentence: ``before`` has words and no sentence ends it."""
    tail = F.rtrim(before)
    return (F.length(tail) > 0) & ~tail.rlike(r"[.!?:;]$")


#: What instructs a reading model rather than a reader. A rule looks at one clause, a stretch without sentence signs, and holds
#: if the clause has a word (or run of words) of each of its sets, one after the other; ``^`` opens the clause.
CLAUSE_RULES = {
    "override": [["ignore", "disregard", "forget", "override", "bypass"], ["previous", "prior", "earlier", "above", "all", "preceding"], ["instruction", "instructions", "prompt", "prompts", "context", "rule", "rules"]],
    "role": [["^you are"], ["ai", "assistant", "chatbot", "bot", "helpful", "language model"]],
    "marker": [["^system :", "^assistant :", "^user :"], ["ignore", "disregard", "forget", "override", "instead", "always", "you are", "you have", "must now", "from now on", "your task", "your job", "your role", "your orders",
                                                          "your new task", "new orders", "new rules", "new instructions"]],
    "exfiltration": [["reveal", "print", "output", "repeat", "disclose", "show"], ["system prompt", "your instructions", "your prompt", "the prompt you", "the prompt that", "the prompt above", "the prompt in", "the prompt verbatim", "the prompt word"]],
    # an order of what to say names it: a quotation, a shouted word, or what follows
    "answer": [[f"{when} {say} {w}{what}" for when in ("always", "instead") for say in ("answer", "respond", "reply", "say") for w in ("", "with ") for what in ("quotation", "shouted", "exactly", "the following", "the text")]],
}
#: Tags that a chat format gives to its turns.
TURN_TAGS = ["system", "assistant", "user", "instruction", "instructions", "prompt"]
REMOVED = "[removed: instruction]"
_PIECE = r"([^.!?;\n]+|[.!?;\n]+)"
TAG = r"(?i)<\s*/?\s*(?:" + "|".join(TURN_TAGS) + r")\s*/?>"
SHAPES = [(r"[\"'“”‘’][^\"'“”‘’]{1,60}[\"'“”‘’]", " quotation "), (r"\b[A-Z]{2,}\b", " shouted ")]


def _clause_words(piece: Column, shapes: bool) -> Column:
    """The words of a clause, each between spaces of its own, a colon as a word; ``shapes`` names quotations and shouted words."""
    if shapes:
        for pattern, name in SHAPES:
            piece = F.regexp_replace(piece, pattern, name)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(F.lower(piece), ":", " : "), "[^a-z0-9:]+", "  ")), F.lit(" "))


def rule_pattern(sets: list[list[str]]) -> str:
    """A rule as a pattern on the words of a clause."""
    start = "^" if sets[0][0].startswith("^") else ""
    return start + ".*".join(" (?:" + "|".join(o.lstrip("^").replace(" ", "  ") for o in options) + ") " for options in sets)


def injections(text: Column) -> Column:
    """``array<struct<rule, piece>>``: the clauses of a text and the signs between them, in order, ``rule`` null where none holds.

    The first rule of :data:`CLAUSE_RULES` that holds is taken. Joined, the pieces give the text back.
    """

    def judge(piece: Column) -> Column:
        def rule(said: Column) -> Column:
            return F.coalesce(*(F.when(said.rlike(rule_pattern(sets)), F.lit(name)) for name, sets in CLAUSE_RULES.items() if name != "answer"))

        by_words = bound(_clause_words(piece, False), rule)
        answer = F.when(_clause_words(piece, True).rlike(rule_pattern(CLAUSE_RULES["answer"])), F.lit("answer"))
        return F.struct(F.coalesce(by_words, answer).alias("rule"), piece.alias("piece"))

    return F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1)), judge)


def sanitised(pieces: Column) -> Column:
    """The text of :func:`injections` with a mark in place of every clause that a rule found and of every tag."""
    kept = F.transform(pieces, lambda p: F.when(p["rule"].isNull(), p["piece"]).otherwise(F.concat(F.regexp_extract(p["piece"], r"^\s*", 0), F.lit(REMOVED))))
    return F.regexp_replace(F.array_join(kept, ""), TAG, REMOVED)


def injection_counts(pieces: Column) -> dict[str, Column]:
    """Spans that each rule found; tags are counted in what the other rules leave."""
    by_rule = lambda name: F.size(F.filter(pieces, lambda p: p["rule"].eqNullSafe(F.lit(name))))
    counts = {name: by_rule(name) for name in CLAUSE_RULES}
    left = F.array_join(F.transform(F.filter(pieces, lambda p: p["rule"].isNull()), lambda p: p["piece"]), "\n")
    return counts | {"tag": F.regexp_count(left, F.lit(TAG))}


# The delimiters around a passage.
PASSAGE_BEGIN, PASSAGE_END = "<<<PASSAGE %s page %s>>>", "<<<END PASSAGE>>>"


def fence(passage_id: Column, page: Column, body: Column) -> Column:
    """The body between delimiters, which it cannot forge.

    No run of three angle signs is left in it, so it holds no delimiter of any kind, and lines that open with
    something in square brackets and close with a page in round ones are replaced.
    """
    lines = F.split(F.regexp_replace(body, "<{3,}|>{3,}", "[signs removed]"), "\n")

    def safe(line: Column) -> Column:
        bare = F.lower(F.regexp_replace(line, r"\s", ""))
        return F.when(F.startswith(bare, F.lit("[")) & F.contains(bare, F.lit("](page")) & F.endswith(bare, F.lit(")")), F.lit("[header removed]")).otherwise(line)

    return F.concat_ws("\n", F.format_string(PASSAGE_BEGIN, passage_id, F.coalesce(page.cast("string"), F.lit("?"))), F.array_join(F.transform(lines, safe), "\n"), F.lit(PASSAGE_END))
