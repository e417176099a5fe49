"""Links to code in the text of a paper."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let

#: Where code, systems and images are hosted.
CODE_URL = r"https?://(?:www\.)?(?:github\.com|gitlab\.[a-z0-9.\-]+|zenodo\.org/record|huggingface\.co)/\S+"
TIRA_URL = r"https?://(?:www\.)?tira\.io/\S+"
DOCKER_IMAGE = r"\bdocker\.io/[\w\-./:]+"
#: Fixed patterns: headings of reference lists, and what says that code is there.
REFERENCES = r"(?imdU)^[ \t]*(?:\d+\.?\s*)?(references|bibliography|works cited)[ \t]*$"
AVAILABILITY = (
    r"(our code|source code|code is available|code are available|code can be found|is available at|are available at|"
    r"we release|publicly available|made available|reproducib|our implementation|our repository|"
    r"github repository|our system is available|we provide the code|implementation is available)"
)
#: Fixed patterns: who owns what a URL names; models that are named without an owner.
OWNER = r"^https?://(?:www\.)?(?:github\.com|gitlab\.[^/]+|huggingface\.co|zenodo\.org)/([^/\s?#]+)"
BARE_MODEL = r"^(bert|roberta|distilbert|albert|xlm|xlnet|gpt2|gpt-2|t5|flan|deberta|electra|bart|mbart|mt5|opt|bloom|llama)[\w.\-]*$"
#: Owners of what others build upon.
THIRD_PARTIES = (
    "huggingface pytorch tensorflow keras fchollet scikit-learn scipy "
    "numpy pandas-dev explosion nltk facebookresearch facebookai facebook "
    "meta-llama google google-research google-bert googlecreativelab microsoft "
    "openai allenai ukplab sentence-transformers cardiffnlp castorini "
    "usnistgov fasterxml rare-technologies stanfordnlp flairnlp deepset-ai "
    "deepset mistralai qwen bigscience eleutherai tiiuae intfloat baai "
    "sentencepiece apache elastic terrier-org terrierteam explosion-ai "
    "spacy-io dmlc xgboost unslothai langchain-ai jina-ai nomic-ai "
    "salesforce databricks mosaicml togethercomputer thudm internlm "
    "openai-community datasets sebastianruder zenodo"
).split()
#: Characters around a link that may hold evidence; how far into a text its references can start.
BEFORE, AFTER = 240, 120
REFERENCES_FROM = 0.3


def clean_url(url: Column) -> Column:
    return F.regexp_replace(url, r"[.,;:)\]]+$", "")


def without_references(text: Column) -> Column:
    """Up to the last heading of a reference list, if that stands past the first third or so."""
    pattern = r"(?sU)\A(.*)" + REFERENCES.replace("(?imdU)", "(?imdU:") + ")"
    before = F.regexp_extract(text, pattern, 1)
    return F.when(text.rlike(REFERENCES) & (F.char_length(before) >= F.char_length(text) * REFERENCES_FROM), before).otherwise(text)


def is_third_party(url: Column) -> Column:
    owner = F.lower(F.regexp_extract(url, "(?i)" + OWNER, 1))
    return (owner != "") & (owner.isin(THIRD_PARTIES) | owner.rlike("(?iU)" + BARE_MODEL))


def _placed(text: Column, pattern: str) -> Column:
    """Matches with their places from 1: each is the first occurrence of its text after the match before it."""
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<url:string,at:int>>").alias("found"))

    def add(done: Column, url: Column) -> Column:
        at = F.call_function("locate", url, text, done["next"])
        return F.struct((at + F.char_length(url)).alias("next"), F.concat(done["found"], F.array(F.struct(url.alias("url"), at.alias("at")))).alias("found"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), start, add, lambda x: x["found"])


def code_links(text: Column) -> Column:
    """Struct of ``code`` (url, evidence), ``third_party`` and ``tira``, each distinct and sorted."""

    def of(body: Column) -> Column:
        return let(_placed(body, "(?iU)" + CODE_URL), lambda placed: parts(body, placed))

    def parts(body: Column, placed: Column) -> Column:
        near = lambda at: F.substring(body, F.greatest(at - BEFORE, F.lit(1)), at + AFTER - F.greatest(at - BEFORE, F.lit(1)))
        each = F.transform(placed, lambda x: F.struct(clean_url(x["url"]).alias("url"), near(x["at"]).rlike("(?iU)" + AVAILABILITY).alias("evidence")))
        return let(F.filter(each, lambda x: x["url"] != ""), lambda urls: answer(body, urls))

    def answer(body: Column, urls: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(F.filter(urls, lambda x: ~is_third_party(x["url"])), lambda x: x["url"])))
        code = F.transform(names, lambda u: F.struct(u.alias("url"), F.exists(urls, lambda x: (x["url"] == u) & x["evidence"]).alias("evidence")))
        others = F.array_sort(F.array_distinct(F.transform(F.filter(urls, lambda x: is_third_party(x["url"])), lambda x: x["url"])))
        found = F.concat(*[F.regexp_extract_all(body, F.lit("(?iU)" + p), F.lit(0)) for p in (TIRA_URL, DOCKER_IMAGE)])
        return F.struct(code.alias("code"), others.alias("third_party"), F.array_sort(F.array_distinct(F.transform(found, clean_url))).alias("tira"))

    return let(without_references(text), of)


def pdf_stem(url: Column) -> Column:
    """Name for a local file from the last part of a URL's path."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)/*$", 1)
    return F.regexp_replace(F.regexp_replace(last, r"(?<=.)\.[^.]*$", ""), r"[^a-zA-Z0-9_\-]", "_")


def link_class(status: Column) -> Column:
    """live, dead or unverified, from the status of a check; null for any other."""
    return F.when(status == "200", "live").when(status.isin("404", "unreachable"), "dead").when(status == "429", "unverified")
