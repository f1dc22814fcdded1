"""Text functions: cleaning, extraction, splitting, lengths, keywords in context, tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseloom.operators.keyed import POSITION, Keyed
from verseloom.runtime import map_batches

_FLAGS = {"I": re.I, "M": re.M, "S": re.S, "X": re.X, "A": re.A}
_PYTHON_ONLY = re.compile(r"\(\?P|\\[ABZz]|\(\?<=|\(\?<!|\(\?\(|\\N|\\g<")


def strip(c: Column) -> Column:
    """All white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@dataclass(frozen=True)
class Rule:
    pattern: str
    replacement: str = ""
    count: int = 0
    flags: str = ""


def regex_clean(c: Column, rules: Sequence[Rule], strip_result: bool = True, preserve_null: bool = True) -> Column:
    """Ordered substitutions. Patterns that Java reads the same stay in the JVM; a limited count, or syntax that only
    Python has, takes an Arrow UDF."""
    if any(r.count or _PYTHON_ONLY.search(r.pattern) or "A" in r.flags for r in rules):
        compiled = [(re.compile(r.pattern, sum(_FLAGS[f] for f in r.flags)), r.replacement, r.count) for r in rules]

        @F.pandas_udf("string")
        def clean(s: pd.Series) -> pd.Series:
            def one(t):
                if t is None:
                    return None
                for p, to, n in compiled:
                    t = p.sub(to, t, count=n)
                return t.strip() if strip_result else t

            return s.map(one, na_action="ignore")

        out = clean(c)
    else:
        out = c
        for r in rules:
            flags = "U" + "".join({"I": "iu", "M": "m", "S": "s", "X": "x"}[f] for f in r.flags)
            out = F.regexp_replace(out, f"(?{flags}){r.pattern}", re.sub(r"\\(\d)", r"$\1", r.replacement.replace("$", "\\$")))
        out = strip(out) if strip_result else out
    return out if preserve_null else F.coalesce(out, F.lit(""))


def extract_pattern(df: DataFrame, field: str, pattern: str, on_unmatched: str = "fill", fill_value: str | None = None) -> DataFrame:
    """Full match; each named group is a column (``data_x`` or ``metadata_x`` give column x of that group)."""
    names = list(re.compile(pattern).groupindex.items())
    if not names:
        raise ValueError("the pattern has no named group")
    java = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m.group(1).replace('_', '')}>", pattern)
    whole, c = f"(?U)^(?:{java})$", F.col(f"`{field}`")
    hit = F.coalesce(c.rlike(whole), F.lit(False))
    if on_unmatched == "fail" and df.where(~hit).limit(1).count():
        raise ValueError("a text doesn't match the pattern")
    return df.withColumns({re.sub(r"^(data|metadata)_", "", n): F.when(hit, F.regexp_extract(c, whole, i)).otherwise(F.lit(fill_value)) for n, i in names})


def decompose(source: Keyed, field: str, delimiter: str, new_key: str, drop_empty: bool = True, strip_parts: bool = True) -> Keyed:
    """Split by a literal; parts are stripped, empty ones dropped, then numbered. Null counts as empty."""
    parts = F.split(F.coalesce(F.col(f"`{field}`"), F.lit("")), "\\Q" + delimiter + "\\E", -1)
    if strip_parts:
        parts = F.transform(parts, strip)
    if drop_empty:
        parts = F.filter(parts, lambda x: x != "")
    own = POSITION in source.df.columns
    out = source.view([field]).select(*source.pk, *([source.order_array().alias("__p")] if own else []), F.posexplode(parts).alias(new_key, "__text"))
    pk = [*source.pk, new_key]
    keyed = out.withColumn(new_key, F.col(new_key).cast("bigint"))
    order = [F.concat("__p", F.array(new_key)).alias(POSITION)] if own else []
    return source.derive(keyed.select(*pk, F.col("__text").alias(field), *order), "extended_key", pk=pk, data=[field])


def text_length(c: Column, unit: str = "characters") -> Column:
    """Code points or white-space separated words, or ``log_`` of them (ln(1+n)). Null counts as empty."""
    t = F.coalesce(c, F.lit(""))
    base = unit.removeprefix("log_")
    n = {"characters": F.char_length(t), "words": F.size(F.filter(F.split(t, r"(?U)\s+"), lambda x: x != ""))}[base].cast("bigint")
    return F.log1p(n) if unit.startswith("log_") else n


_KWIC_TOKEN = re.compile(r"[\w\-']+|[^\w\s]")


def kwic(df: DataFrame, keys: Sequence[str], field: str, pattern: str, window: int = 5, valuetype: str = "literal", case_sensitive: bool = False, word_boundary: bool = True) -> DataFrame:
    """Every match in its context: keys, ``match_no``, ``start``, ``end``, ``pre``, ``keyword``, ``post``. Contexts are
    ``window`` tokens (a run of word characters, or one mark) as slices of the text. A matrix has no texts: an error."""
    if not isinstance(df, DataFrame):
        raise TypeError("keywords in context need a table with texts; take the rows of a matrix by their key from its base")
    body = re.escape(pattern) if valuetype == "literal" else re.escape(pattern).replace(r"\*", r"\w*").replace(r"\?", r"\w") if valuetype == "glob" else pattern
    if word_boundary:
        body = rf"(?<!\w)(?:{body})(?!\w)"
    compiled = re.compile(body, 0 if case_sensitive else re.I)
    kinds = {k: df.schema[k].dataType.simpleString() for k in keys}

    def run(*columns: pa.Array):
        out: dict[str, list] = {k: [] for k in (*keys, "match_no", "start", "end", "pre", "keyword", "post")}
        for *ks, text in zip(*(c.to_pylist() for c in columns)):
            for n, m in enumerate(compiled.finditer(text or "")):
                a, b = m.span()
                back = 64 * window
                left = [t.start() for t in _KWIC_TOKEN.finditer(text, max(0, a - back), a)]
                while len(left) <= window and 0 < back < a:  # the first token may be cut: one more than needed, or all the text
                    back *= 2
                    left = [t.start() for t in _KWIC_TOKEN.finditer(text, max(0, a - back), a)]
                right = []
                for t in _KWIC_TOKEN.finditer(text, b):
                    right.append(t.end())
                    if len(right) == window:
                        break
                pre = text[left[max(0, len(left) - window)] : a].strip() if left and window else ""
                for k, v in zip(out, (*ks, n, a, b, pre, m.group(), text[b : right[-1]].strip() if right else "")):
                    out[k].append(v)
        yield out

    schema = ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", match_no int, start int, end int, pre string, keyword string, post string"
    return map_batches(df.select(*keys, F.col(f"`{field}`")), run, schema)


def kwic_lines(hits: DataFrame, keys: Sequence[str], width: int = 40, rows: int | None = 20, sample_seed: int | None = None) -> list[str]:
    """Lines to print: a header with the number of matches, then key, context, match and context in columns, the first
    ``rows`` matches in key order, or a seeded sample of them. Only the lines shown come to the driver."""
    total = hits.count()
    order = [F.xxhash64(F.lit(sample_seed), *keys, "match_no")] if sample_seed is not None else []
    few = hits.orderBy(*order, *keys, "match_no")
    shown = (few if rows is None else few.limit(rows)).collect()
    flat = lambda t: re.sub(r"\s+", " ", t)
    out = [f"{total} match{'' if total == 1 else 'es'}" + (f", {len(shown)} shown" if len(shown) < total else "")]
    for r in sorted(shown, key=lambda r: [r[k] for k in (*keys, "match_no")]):
        out.append(f"{', '.join(str(r[k]) for k in keys)}  {flat(r.pre)[-width:]:>{width}} [{flat(r.keyword)}] {flat(r.post)[:width]}")
    return out


def tokens(c: Column, lowercase: bool = True) -> Column:
    """Words of two or more word characters, in order."""
    return F.regexp_extract_all(F.lower(c) if lowercase else c, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def ngrams(words: Column, low: int, high: int, separator: str = " ") -> Column:
    """All n-grams of an array of words, ``low`` to ``high`` words long."""
    parts = []
    for n in range(low, high + 1):
        count = F.size(words) - (n - 1)
        parts.append(F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i, n=n: F.array_join(F.slice(words, i, F.lit(n)), separator))).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def char_ngrams(c: Column, low: int, high: int, within_words: bool = False) -> Column:
    """Character n-grams of the text, or of each word padded with a space on both sides."""
    text = F.regexp_replace(c, r"(?U)\s+", " ")
    units = F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" "))) if within_words else F.array(text)
    grams = [F.flatten(F.transform(units, lambda u, n=n: F.when(F.char_length(u) >= n, F.transform(F.sequence(F.lit(1), F.char_length(u) - n + 1), lambda i, u=u: F.substr(u, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))) for n in range(low, high + 1)]
    return F.concat(*grams)


_RULE_SENTENCE = regex.compile(r"[^.!?。！？।؟]+(?:[.!?。！？।؟]+[\"”»’)\]]*|\Z)", regex.S)
_RULE_TOKEN = regex.compile(r"\w+(?:['’\-]\w+)*|[^\w\s]")


def linguistic_tokens(df: DataFrame, pk: Sequence[str], field: str, backend: Callable | None = None, extra: str = "") -> DataFrame:
    """Sentences and tokens: key, ``sentence_id``, ``token_id``, ``text``, ``lemma``, ``is_alpha``, ``is_punct``, ``start``,
    and the columns of the schema ``extra`` (such as ``pos string, head bigint``), null where the backend gives none.

    ``backend(text)`` gives sentences as lists of dicts with those names; without one, plain rules are used (they give no
    parse and take the lower-case form as the lemma)."""
    from pyspark.sql import types as T

    def rules(text: str) -> list[list[dict]]:
        out = []
        for s in _RULE_SENTENCE.finditer(text):
            if s.group().strip():
                out.append([{"text": t.group(), "lemma": t.group().lower(), "is_alpha": t.group().isalpha(), "is_punct": not t.group()[0].isalnum(), "start": t.start()} for t in _RULE_TOKEN.finditer(text, s.start(), s.end())])
        return out

    analyse = backend or rules
    names = ("text", "lemma", "is_alpha", "is_punct", "start")
    more = [f.name for f in T._parse_datatype_string(extra)] if extra else []

    def run(*columns: pa.Array):
        out: dict[str, list] = {k: [] for k in (*pk, "sentence_id", "token_id", *names, *more)}
        for *ks, text in zip(*(c.to_pylist() for c in columns)):
            for i, sentence in enumerate(analyse(text or "")):
                for j, tok in enumerate(sentence):
                    for k, v in zip(out, (*ks, i, j, *(tok[n] for n in names), *(tok.get(n) for n in more))):
                        out[k].append(v)
        yield out

    schema = ", ".join(f"{k} bigint" for k in pk) + ", sentence_id bigint, token_id bigint, text string, lemma string, is_alpha boolean, is_punct boolean, start int" + (f", {extra}" if extra else "")
    return map_batches(df.select(*pk, F.col(f"`{field}`")), run, schema)


def with_backend(df: DataFrame, pk: Sequence[str], fields: Sequence[str], backend: Callable | None, schema: str, what: str) -> DataFrame:
    """Rows that an injected model gives for each row: ``backend(dict of fields) -> list of dicts``. A row that fails gives
    one row with its ``error``."""
    if backend is None:
        raise RuntimeError(f"{what} needs a model: pass backend=, a function of a row that gives its records")
    from pyspark.sql import types as T

    names = [f.name for f in T._parse_datatype_string(schema)]

    def run(*columns: pa.Array):
        out: dict[str, list] = {k: [] for k in (*pk, "item_no", *names, "error")}
        for row in zip(*(c.to_pylist() for c in columns)):
            ks, values = row[: len(pk)], dict(zip(fields, row[len(pk) :]))
            try:
                found, error = list(backend(values)), None
            except Exception as e:  # one row's failure isn't the job's
                found, error = [{}], f"{type(e).__name__}: {e}"
            for i, r in enumerate(found):
                for k, v in zip(out, (*ks, i, *(r.get(n) for n in names), error)):
                    out[k].append(v)
        yield out

    return map_batches(df.select(*pk, *fields), run, ", ".join(f"{k} bigint" for k in pk) + f", item_no int, {schema}, error string")


def head_of_span(tokens_: Sequence[dict], start: int, end: int) -> int:
    """Position of a span's head: the token whose dependency head lies outside the span, else is itself; the first of several
    that isn't punctuation."""
    roots = [t for t in tokens_ if start <= t["token_id"] <= end and (t["head"] == t["token_id"] or not start <= t["head"] <= end)]
    words = [t for t in roots if not t.get("is_punct")] or roots
    return words[0]["token_id"] if words else start


def span_heads(tokens_: DataFrame, spans: DataFrame, sentence_key: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Every span (its sentence's key, first and last token, other columns) with ``head_token``, by the rule of
    :func:`head_of_span`, from a table of tokens with ``token_id``, ``head`` and ``is_punct``. Equal spans count once; a
    span without a token has its start."""
    key = list(sentence_key)
    t = tokens_.select(*key, F.col("token_id").alias("__t"), F.col("head").alias("__h"), F.coalesce(F.col("is_punct"), F.lit(False)).alias("__p"))
    wide = spans.distinct().withColumn("__a", F.col(f"`{start}`")).withColumn("__b", F.col(f"`{end}`"))
    inside = wide.join(t, key).where(F.col("__t").between(F.col("__a"), F.col("__b")))
    root = (F.col("__h") == F.col("__t")) | ~F.col("__h").between(F.col("__a"), F.col("__b"))
    found = inside.where(root).groupBy(*[F.col(f"`{c}`") for c in spans.columns]).agg(F.min_by("__t", F.struct("__p", "__t")).alias("head_token"))
    same = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in spans.columns]
    return spans.distinct().alias("l").join(found.alias("r"), same, "left").select("l.*", F.coalesce("r.head_token", F.col(f"l.`{start}`")).alias("head_token"))


def select_senses(candidates: DataFrame, token_key: Sequence[str], force: dict[str, str] | None = None, exclude: Sequence[str] = (), lemma_allow: dict[str, Sequence[str]] | None = None, token_allow: Column | None = None) -> DataFrame:
    """One sense for each token: a forced one, else of what is neither excluded nor disallowed the lowest rank, then sense
    and candidate id. Tokens without a candidate left have no row."""
    from pyspark.sql import Window

    c = candidates
    for lemma, sense in (force or {}).items():
        c = c.where((F.col("lemma") != lemma) | (F.col("sense_id") == sense))
    if exclude:
        c = c.where(~F.col("sense_id").isin(list(exclude)))
    for lemma, senses in (lemma_allow or {}).items():
        c = c.where((F.col("lemma") != lemma) | F.col("sense_id").isin(list(senses)))
    if token_allow is not None:
        c = c.where(token_allow)
    w = Window.partitionBy(*token_key).orderBy("rank", "sense_id", "candidate_id")
    return c.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def porter_stem(word: str) -> str:
    """Porter's stemmer, after the published description of its five steps."""
    if len(word) <= 2:
        return word
    vowel = lambda w, i: w[i] in "aeiou" or (w[i] == "y" and i > 0 and not vowel(w, i - 1))

    def measure(w: str) -> int:
        shape = re.sub(r"(.)\1+", r"\1", "".join("v" if vowel(w, i) else "c" for i in range(len(w))))
        return shape.count("vc")

    has_vowel = lambda w: any(vowel(w, i) for i in range(len(w)))
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and not vowel(w, len(w) - 1)
    cvc = lambda w: len(w) > 2 and not vowel(w, len(w) - 3) and vowel(w, len(w) - 2) and not vowel(w, len(w) - 1) and w[-1] not in "wxy"
    w = word
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, to in sorted((x.split(":") for x in table.split()), key=lambda x: -len(x[0])):
            if w.endswith(end):
                w = w[: -len(end)] + to if measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted(_STEP4.split(), key=lambda x: -len(x)):
        if w.endswith(end):
            stem = w[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if measure(w) > 1 and double(w) and w[-1] == "l" else w


def stemmed(words: Column) -> Column:
    """An array of words as their stems."""

    @F.pandas_udf("array<string>")
    def stems(s: pd.Series) -> pd.Series:
        cache: dict[str, str] = {}
        return s.map(lambda ws: None if ws is None else [cache.get(w) or cache.setdefault(w, porter_stem(w)) for w in ws])

    return stems(words)
