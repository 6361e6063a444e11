"""Text normalisation as native column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# The common English stop-word list.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Word characters are spelled out as Unicode classes: Java's \w is ASCII only.
WORD = r"[\p{L}\p{N}_]{2,}"
ALPHABETIC = r"^\p{L}+$"
BLANKS = r"[\s\p{Z}]+"
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\s\p{Z}\p{L}\p{N}_]"

# Plural endings of English nouns and their singular endings.
NOUN_ENDINGS = (("ies", "y"), ("ches", "ch"), ("shes", "sh"), ("sses", "ss"), ("xes", "x"), ("s", ""))
# Plurals that their endings do not tell.
IRREGULAR = {
    "buses": "bus", "calves": "calf", "children": "child", "feet": "foot", "geese": "goose", "halves": "half",
    "knives": "knife", "leaves": "leaf", "lives": "life", "loaves": "loaf", "men": "man", "mice": "mouse",
    "movies": "movie", "people": "person", "quizzes": "quiz", "selves": "self", "series": "series", "shelves": "shelf",
    "species": "species", "teeth": "tooth", "thieves": "thief", "wives": "wife", "wolves": "wolf", "women": "woman",
}
KEEPS_S = ("ss", "us", "is")


def clean(text: Column, lowercase: bool = True, remove_punctuation: bool = True) -> Column:
    """Null becomes empty; then lower case; then punctuation is deleted, not replaced."""
    out = F.coalesce(text, F.lit(""))
    if lowercase:
        out = F.lower(out)
    if remove_punctuation:
        out = F.translate(out, PUNCTUATION, "")
    return out


def split_words(text: Column, punctuation_removed: bool = True) -> Column:
    if punctuation_removed:
        return F.filter(F.split(text, BLANKS), lambda t: t != "")
    return F.regexp_extract_all(text, F.lit(WORD_OR_MARK), F.lit(0))


def drop_stop_words(tokens: Column, words: list[str] | None = None) -> Column:
    listed = STOP_WORDS if words is None else list(words)
    return F.filter(tokens, lambda t: ~t.isin(listed)) if listed else tokens


def keep_alphabetic(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(ALPHABETIC))


def lemma(token: Column) -> Column:
    """Singular form of an English noun: from the fixed list, else by its ending."""
    known = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    out = F.when(token.isin(list(IRREGULAR)), F.try_element_at(known, token)).when(F.length(token) <= 3, token)
    for ending in KEEPS_S:
        out = out.when(token.endswith(ending), token)
    for ending, singular in NOUN_ENDINGS:
        stem = token.substr(F.lit(1), F.length(token) - len(ending))
        out = out.when(token.endswith(ending), F.concat(stem, F.lit(singular)))
    return out.otherwise(token)


def lemmatize(tokens: Column, lexicon: Mapping[str, str] | None = None) -> Column:
    """Lemma of each token; words in the (small, literal) lexicon take its form."""
    if not lexicon:
        return F.transform(tokens, lemma)
    pairs = [F.lit(part) for pair in lexicon.items() for part in pair]
    known = F.create_map(*pairs)
    listed = list(lexicon)
    return F.transform(tokens, lambda t: F.when(t.isin(listed), known[t]).otherwise(lemma(t)))


def normalized_tokens(
    text: Column,
    lowercase: bool = True,
    remove_punctuation: bool = True,
    remove_stopwords: bool = True,
    lemmatized: bool = True,
    stemmed: bool = False,
    lexicon: Mapping[str, str] | None = None,
) -> Column:
    tokens = split_words(clean(text, lowercase, remove_punctuation), remove_punctuation)
    if remove_stopwords:
        tokens = drop_stop_words(tokens)
    if lemmatized:
        tokens = lemmatize(tokens, lexicon)
    if stemmed:
        from voxtide.functions.stemming import stem_tokens

        tokens = stem_tokens(tokens)
    return tokens


def preprocess(df: DataFrame, text_column: str = "feedback_text", **options) -> DataFrame:
    """Add `processed_text`; a table that has it already is returned as it is."""
    if "processed_text" in df.columns:
        return df
    tokens = normalized_tokens(F.col(text_column), **options)
    return df.withColumn("processed_text", F.array_join(tokens, " "))


def topic_tokens(text: Column, lemmatized: bool = True) -> Column:
    """Tokens for topic search: words of letters only, without stop words."""
    tokens = split_words(F.lower(F.coalesce(text, F.lit(""))), punctuation_removed=False)
    tokens = drop_stop_words(keep_alphabetic(tokens))
    return lemmatize(tokens) if lemmatized else tokens


def word_tokens(text: Column) -> Column:
    """Tokens for counting: lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All runs of `low` to `high` tokens, joined by one space."""
    if not 1 <= low <= high:
        raise ValueError(f"bad n-gram range: ({low}, {high})")
    runs = []
    for n in range(low, high + 1):
        if n == 1:
            runs.append(tokens)
            continue
        parts = [F.slice(tokens, k + 1, F.greatest(F.size(tokens) - n + 1, F.lit(0))) for k in range(n)]
        run = parts[0]
        for part in parts[1:]:
            run = F.zip_with(run, part, lambda a, b: F.concat(a, F.lit(" "), b))
        runs.append(run)
    return runs[0] if len(runs) == 1 else F.concat(*runs)


def feedback_code(number: Column) -> Column:
    """Identifier such as F000042."""
    return F.format_string("F%06d", number)


def course_code(subject: Column, number: Column) -> Column:
    return F.concat(F.upper(F.substring(subject, 1, 3)), number.cast("string"))


def column_label(text: str) -> str:
    return text.replace(" ", "_")
