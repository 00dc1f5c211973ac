"""Freely entered names mapped to the entries of a reference list, by a prefix-filter set-similarity join.

A name and a form of an entry are sets of the list's words: a name's set holds the words that its
own words say, misspelt or not, and a form is met if the name's set covers it.  Words are ordered
by rarity over all names and forms, so a form is found by its rarest word alone; the length and
the position of that word in the name's set rule out most of the rest, and what is left is
verified exactly.  Words written as one have no words to be ordered: such texts meet the forms of
whose words they hold a half, a Levenshtein bound in the JVM rules out most, and the rest is
verified too.  Of the forms that a name says, the one with the fewest errors is its meaning, then
the one with the most alike bigrams (Jaccard).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.storage import Scratch

#: Least Jaccard similarity of the bigrams of a name and a form in whose short words or codes there may be errors.
LEAST = 0.35
#: Cost of a word that isn't meant, more than all errors of any name.
NONE = 1e6
#: Words up to which all orders of a form are tried when it is written as one; longer forms are cut into their words.
ORDERS = 4
#: Words without a meaning of their own, which an entry's form doesn't need.
LINKING = frozenset({"of", "the", "a", "an"})

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W_]+")


def words_of(name: str | None) -> list[str]:
    """The words of a name in lower case, without accents, odd widths and invisible characters; camel case is split."""
    if not name:
        return []
    text = "".join(c for c in unicodedata.normalize("NFKC", name) if unicodedata.category(c) not in ("Cf", "Cc") or c.isspace())
    text = unicodedata.normalize("NFKD", _CAMEL.sub(" ", text)).casefold()
    return _WORD.findall("".join(c for c in text if not unicodedata.combining(c)))


def bigrams(words: list[str]) -> list[int]:
    """The bigrams of the words written as one, each once and as a number; a single letter is its own."""
    text = "".join(words)
    if len(text) == 1:
        return [ord(text)]
    return sorted({ord(a) << 21 | ord(b) for a, b in zip(text, text[1:])})


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            new.append(cost)
        if min(new) > most:
            return most + 1
        older, old = old, new
    return min(old[-1], most + 1)


def singular(word: str) -> str:
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


@lru_cache(1 << 16)
def word_cost(word: str, meant: str) -> float | None:
    """0 for equal words, 0.5 for plurals, 1 or 1.5 with one error; None if they differ by more.

    Words with digits are codes: they must be equal.  Short words allow no error.
    """
    if word == meant:
        return 0.0
    if any(c.isdigit() for c in word + meant):
        return None
    if singular(word) == singular(meant):
        return 0.5
    if min(len(word), len(meant)) < 4:
        return None
    if edits(word, meant, 1) == 1:
        return 1.0
    return 1.5 if edits(singular(word), singular(meant), 1) == 1 else None


def split_cost(word: str, parts: tuple[str, ...]) -> int:
    """The errors of a word that can be cut into all parts, in any order and each with one error at most; more than there are parts if it can't."""
    states = {(tuple(sorted(parts)), 0): 0}
    for _ in parts:
        after: dict = {}
        for (left, at), errors in states.items():
            for i, part in enumerate(left):
                if i and part == left[i - 1]:
                    continue
                for end in range(at + len(part) - 1, min(at + len(part) + 1, len(word)) + 1):
                    if (c := edits(word[at:end], part, 1)) <= 1:
                        key = (left[:i] + left[i + 1 :], end)
                        after[key] = min(errors + c, after.get(key, errors + c))
        states = after
    return states.get(((), len(word)), len(parts) + 1)


def assigned(costs: list[list[float]]) -> float:
    """The least sum of a different column for each row, of which there are no more than columns (Hungarian method)."""
    n, m = len(costs), len(costs[0])
    u, v, row, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row[0], at, least, used = i, 0, [float("inf")] * (m + 1), [False] * (m + 1)
        while row[at]:
            used[at] = True
            for j in range(1, m + 1):
                if not used[j] and (c := costs[row[at] - 1][j - 1] - u[row[at]] - v[j]) < least[j]:
                    least[j], way[j] = c, at
            nearest = min((j for j in range(1, m + 1) if not used[j]), key=least.__getitem__)
            delta = least[nearest]
            for j in range(m + 1):
                if used[j]:
                    u[row[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            at = nearest
        while at:
            row[at], at = row[way[at]], way[at]
    return sum(costs[row[j] - 1][j - 1] for j in range(1, m + 1) if row[j])


@lru_cache(1 << 16)
def joined_cost(word: str, parts: tuple[str, ...]) -> float | None:
    """The cost of several words written as one, in any order, with one error for each of them."""
    if any(c.isdigit() for c in word) or abs(len(word) - sum(map(len, parts))) > len(parts):
        return 0.25 if word == "".join(parts) else None
    if len(parts) > ORDERS:  # with errors anywhere, as below, a whole word could be missing
        best = min(split_cost(w, parts) for w in (word, singular(word)))
    else:
        best = min(edits(w, "".join(p), len(parts)) for p in permutations(parts) for w in (word, singular(word)))
    return 0.25 + best if best <= len(parts) else None


def meaning(form: list[str]) -> list[str]:
    """The words of a form that a name must have."""
    return [w for w in form if w not in LINKING] or form


def as_one(name: list[str]) -> set[str]:
    """The texts of a name that may be several words written as one."""
    texts = {*name, "".join(name)}
    return texts | {"".join(name[1:]), "".join(name[:-1])} if len(name) > 2 else texts  # a word split off in front or behind


def jaccard(name: list[str], form: list[str]) -> float:
    a, b = set(bigrams(name)), set(bigrams(form))
    return len(a & b) / len(a | b)


def cost(name: list[str], form: list[str]) -> float | None:
    """The errors with which a name says all words of a form; None if it lacks one of them."""
    meant = meaning(form)
    if len(meant) <= len(name):
        costs = [[NONE if (c := word_cost(w, m)) is None else c for w in name] for m in meant]
        if all(min(c) < NONE for c in costs) and (total := assigned(costs)) < NONE:
            return total
    options = [c for w in as_one(name) if (c := joined_cost(w, tuple(meant))) is not None]
    # Short words and codes allow no error of their own: more errors than long words are for names alike as a whole ("mat" isn't "my cat").
    sure = 0 if any(c.isdigit() for w in meant for c in w) else sum(len(w) >= 4 for w in meant)
    if options and (min(options) - 0.25 <= sure or jaccard(name, form) >= LEAST):
        return min(options)
    return None


def spellings(word: str) -> set[str]:
    """Texts of which two words share one if ``word_cost`` accepts them: each and its singular, also with one letter less."""
    own = {word, singular(word)}
    return own | {w[:i] + w[i + 1 :] for w in own for i in range(len(w))}


def pieces(word: str, errors: int) -> set[tuple[int, str]]:
    """Offsets and texts of which one stands, moved by no more places than there are ``errors``, in every text with that many.

    The word is cut into one part more than there are errors, so one part is whole; a swap across a
    cut touches two parts, but leaves each of them with the first or last letter of the other.
    """
    cuts = [len(word) * i // (errors + 1) for i in range(errors + 2)]
    out = set()
    for a, b in zip(cuts, cuts[1:]):
        firsts = {word[a:b]} | ({word[a - 1] + word[a + 1 : b]} if 0 < a < b else set())
        out |= {(a, t) for f in firsts for t in ({f, f[:-1] + word[b]} if a < b < len(word) else {f})}
    return out


def form_pieces(meant: list[str]) -> set[tuple[int, str]]:
    """The pieces of a form written as one, in any order of its words; of long forms, those of each word, anywhere (offset -1)."""
    if len(meant) > ORDERS:  # each word has one error at most there
        return {(-1, t) for w in set(meant) for _, t in pieces(w, 1)}
    return set().union(*(pieces("".join(p), len(meant)) for p in permutations(meant)))


def _mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """``run`` turns a DataFrame of a batch into one of ``schema``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield run(pdf)

    return df.mapInPandas(each, schema)


def _worded(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and its words as one text; names without any word are left out."""
    rows = df.select(F.col(key).cast("string").alias(key), F.col(text).cast("string").alias("_text"))
    return _mapped(rows, lambda pdf: pd.DataFrame({key: pdf[key], "words": pdf["_text"].map(lambda t: " ".join(words_of(t)))}), f"{key} string, words string").where("words <> ''")


def _singular(c: Column) -> Column:
    """``singular`` in the JVM."""
    n = F.length(c)
    return F.when((n > 4) & c.endswith("ies"), F.concat(c.substr(F.lit(1), n - 3), F.lit("y"))).when((n > 3) & c.endswith("s") & ~c.endswith("ss"), c.substr(F.lit(1), n - 1)).otherwise(c)


def forms_of(catalog: DataFrame) -> DataFrame:
    """form, type_id, meant (its different words with a meaning), parts (how many), size (their letters), orders (all ways to write them as one, '' for long forms).

    Equal forms of several entries are one, of the smallest type_id.
    """
    listed = catalog.where("type_id is not null").select(F.col("type_id").cast("string").alias("type_id"), F.explode(F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    worded = _worded(listed.where("form is not null").select(F.struct("type_id", "form").alias("k")).select(F.to_json("k").alias("k"), "k.form"), "k", "form")
    once = worded.groupBy(F.col("words").alias("form")).agg(F.min(F.get_json_object("k", "$.type_id")).alias("type_id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        meant = [meaning(f.split(" ")) for f in pdf["form"]]
        orders = [sorted({"".join(p) for p in permutations(m)}) if len(m) <= ORDERS else [""] for m in meant]
        return pd.DataFrame({"form": pdf["form"], "type_id": pdf["type_id"], "meant": [sorted(set(m)) for m in meant], "parts": [len(m) for m in meant], "size": [len("".join(m)) for m in meant], "orders": orders})

    return _mapped(once, run, "form string, type_id string, meant array<string>, parts int, size int, orders array<string>")


def _said(words: DataFrame, meant: DataFrame) -> DataFrame:
    """word, meant: the words of forms that each word says, by spellings that both share."""
    spelled = lambda df, c: _mapped(df.select(c), lambda pdf: pd.DataFrame([(w, s) for w in pdf[c] for s in spellings(w)], columns=[c, "spelling"]), f"{c} string, spelling string")
    pairs = spelled(words, "word").join(spelled(meant, "meant"), "spelling").select("word", "meant").distinct()
    return _mapped(pairs, lambda pdf: pdf[[word_cost(w, m) is not None for w, m in zip(pdf["word"], pdf["meant"])]], "word string, meant string")


def covered_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """l, r of all pairs of which the set of ``left`` (l, tokens) holds that of ``right`` (r, tokens).

    A prefix-filter join for an overlap of the whole right set: ordered by global rarity, its
    prefix is its rarest token.  In the left set no fewer tokens than the right one has must
    stand from that token on, which bounds the sizes of both too.  Sets are of different tokens.
    """
    l, r = left.select("l", F.explode("tokens").alias("token"), F.size("tokens").alias("n")), right.select("r", F.explode("tokens").alias("token"), F.size("tokens").alias("m"))
    rarity = l.select("token").unionByName(r.select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    ordered = l.join(rarity, "token").select("l", "n", F.row_number().over(Window.partitionBy("l").orderBy("uses", "token")).alias("at"), "token")
    prefix = r.join(rarity, "token").groupBy("r").agg(F.min(F.struct("uses", "token"))["token"].alias("token"), F.max("m").alias("m"))
    met = ordered.join(prefix, "token").where("n - at + 1 >= m").select("l", "r")
    full = met.join(left, "l").withColumnRenamed("tokens", "lt").join(right, "r").withColumnRenamed("tokens", "rt")
    return full.where(F.size(F.array_except("rt", "lt")) == 0).select("l", "r")


def joined_pairs(texts: DataFrame, forms: DataFrame, scratch: Scratch) -> DataFrame:
    """text, form of the forms that a text may be when written as one.

    A form written as one, in each order of its words, is cut into one piece more than it may have
    errors, so a text that says it holds a piece whole and near its place.  What meets so, and is
    about as long, is bounded by the Levenshtein distance, in which a swap counts two.
    """
    cut = _mapped(forms.select("form"), lambda pdf: pd.DataFrame([(f, at, p) for f in pdf["form"] for at, p in form_pieces(meaning(f.split(" ")))], columns=["form", "offset", "piece"]), "form string, offset int, piece string")
    held = scratch.save(cut.join(forms.select("form", "parts", "size", "orders"), "form"), "pieces")
    lengths = [r[0] for r in held.select(F.length("piece")).distinct().collect()]  # no more than the longest form has letters
    longest = held.agg(F.max(F.col("size") + F.col("parts"))).first()[0] or 0
    each = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.struct((i - 1).cast("int").alias("at"), F.substring(c, i, n).alias("piece")))
    none = F.array().cast("array<struct<at:int,piece:string>>")
    cuts = lambda c: F.flatten(F.array(*(F.when(F.length(c) >= n, each(c, n)).otherwise(none) for n in sorted(lengths)))) if lengths else none
    # Texts are few bytes but many pieces, so they are dealt to all cores; by a hash, as AQE would put the few bytes of a shuffle by text into one task.
    spark = texts.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = texts.where(F.length("text") <= longest).repartition(tasks, F.xxhash64("text")).withColumn("one", _singular(F.col("text")))
    held_by = own.select("text", "one", F.explode(F.concat(cuts(F.col("text")), F.when(F.col("one") != F.col("text"), cuts(F.col("one"))).otherwise(none))).alias("c")).select("text", "one", "c.at", "c.piece")
    near = (F.abs(F.length("text") - F.col("size")) <= F.col("parts")) & ((F.col("offset") < 0) | (F.abs(F.col("at") - F.col("offset")) <= F.col("parts")))
    met = held_by.join(held, "piece").where(near)
    most = 2 * F.col("parts")
    like = F.exists("orders", lambda o: (o == "") | (F.levenshtein(F.col("text"), o) <= most) | (F.levenshtein(F.col("one"), o) <= most))
    return met.where(like).select("text", "form").distinct()


def candidate_pairs(names: DataFrame, forms: DataFrame, scratch: Scratch) -> DataFrame:
    """words, form: every form that ``cost`` accepts for the words of a name, and few others."""
    word = scratch.save(names.select("words", F.explode(F.array_distinct(F.split("words", " "))).alias("word")), "word")
    said = scratch.save(_said(word.select("word").distinct(), forms.select(F.explode("meant").alias("meant")).distinct()), "said")
    sets = word.join(said, "word").groupBy(F.col("words").alias("l")).agg(F.collect_set("meant").alias("tokens"))
    by_words = covered_sets(scratch.save(sets, "sets"), forms.select(F.col("form").alias("r"), F.col("meant").alias("tokens"))).select(F.col("l").alias("words"), F.col("r").alias("form"))
    texts = scratch.save(_mapped(names.select("words"), lambda pdf: pd.DataFrame([(w, t) for w in pdf["words"] for t in sorted(as_one(w.split(" "))) if t], columns=["words", "text"]), "words string, text string"), "texts")
    by_text = texts.join(joined_pairs(texts.select("text").distinct(), forms, scratch), "text").select("words", "form")
    return by_words.unionByName(by_text).distinct()


def map_names(names: DataFrame, catalog: DataFrame, scratch: Scratch) -> DataFrame:
    """name, type_id, jaccard, errors of each different name that an entry of ``catalog`` is meant by.

    ``names``: name; ``catalog``: type_id, canonical_name, aliases.  Names without an entry (also
    NULL, blanks and placeholders) don't come out.  The entry with the fewest errors is kept, then
    the most similar, then the smallest type_id.  Neither side is held in one place.
    """
    once = scratch.save(_worded(names.where("name is not null").distinct(), "name", "name"), "names")
    forms = scratch.save(forms_of(catalog), "forms")
    pairs = scratch.save(candidate_pairs(once.select("words").distinct(), forms, scratch), "pairs")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        split = [(w.split(" "), f.split(" ")) for w, f in zip(pdf["words"], pdf["form"])]
        errors = [cost(w, f) for w, f in split]
        alike = [None if e is None else jaccard(w, f) for (w, f), e in zip(split, errors)]
        out = pd.DataFrame({"words": pdf["words"], "form": pdf["form"], "errors": errors, "jaccard": alike}).astype({"errors": "float64", "jaccard": "float64"})
        return out[out["errors"].notna()]

    checked = _mapped(pairs, run, "words string, form string, errors double, jaccard double")
    order = F.struct("errors", (-F.round("jaccard", 9)).alias("alike"), "type_id")
    best = checked.join(forms.select("form", "type_id"), "form").groupBy("words").agg(F.min(F.struct(order.alias("o"), "jaccard")).alias("b"))
    return once.join(best, "words").select("name", "b.o.type_id", "b.jaccard", "b.o.errors")


def assign(candidates: DataFrame, mapped: DataFrame) -> DataFrame:
    """candidate_id, type_id of each candidate (its current row); '' where no entry is meant."""
    from kinweave.sources.tables import current_rows

    rows = current_rows(candidates, "candidate_id", "proposed_name")
    joined = rows.join(mapped.select(F.col("name").alias("proposed_name"), "type_id"), "proposed_name", "left")
    return joined.select("candidate_id", F.coalesce("type_id", F.lit("")).alias("type_id"))
