"""From sections of papers to ranked task records.

A section's papers are grouped into tasks: overviews are found by their titles,
every other paper goes to one of them or is dropped where its title doesn't tell. Tasks
are joined with counts, links and parsed texts, checked, ranked and reported.

Papers come as rows: parent_venue, year, volume, section, section_no, position,
title, authors, pdf_url. Token weights are kept as exact fractions of a common
denominator, so that ties are ties.
"""

from __future__ import annotations

import logging
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import titles
from corpusloom.functions.facts import round_exact
from corpusloom.functions.links import link_class

log = logging.getLogger(__name__)
SECTION = ["parent_venue", "year", "volume", "section_no"]
#: Up to this many overviews in a section weights are exact: a multiple of all counts.
EXACT_UP_TO = 20
_UNIT = lcm(*range(1, EXACT_UP_TO + 1))
RATIO_BOUNDS = (0.0, 1.5)
CONFIDENCE_ORDER = {"high": 0, "medium": 1, "low": 2}
TARGET = 50
CSV_COLUMNS = (
    "task_id venue parent_venue year task_name ceur_volume "
    "overview_title overview_pdf_url overview_authors is_umbrella "
    "notebook_papers teams_claimed_in_overview runs_claimed_in_overview coverage_ratio "
    "participant_pdf_urls team_names overview_fulltext_path participant_fulltext_paths "
    "code_urls code_urls_live tira_refs "
    "task_assignment_method confidence extracted_at"
).split()


def match_authors(papers: DataFrame, bibliography: DataFrame) -> DataFrame:
    """``papers`` with authors from a second bibliography (title, authors, ord) where titles agree, and ``dblp_match``.

    Of equal titles the last entry counts. An empty author list is a match but replaces nothing.
    """
    key = titles.normalize_title(F.col("title"))
    last = bibliography.groupBy(key.alias("_key")).agg(F.max_by("authors", "ord").alias("_authors"))
    joined = papers.withColumn("_key", key).join(last, "_key", "left")
    better = F.size(F.coalesce("_authors", F.array())) > 0
    return joined.withColumn("dblp_match", F.col("_authors").isNotNull()).withColumn("authors", F.when(better, F.col("_authors")).otherwise(F.col("authors"))).drop("_key", "_authors")


def mark_overviews(papers: DataFrame) -> DataFrame:
    """Papers without re-publications, with ``is_overview``; the first stands in where no title says so."""
    kept = papers.filter(~F.col("title").rlike(titles.BEST_OF_LABS))
    w = Window.partitionBy(*SECTION)
    named = F.col("title").rlike(titles.OVERVIEW) | F.col("title").rlike(titles.ORGANISER)
    first = F.col("position") == F.min("position").over(w)
    marked = kept.withColumn("_named", named).withColumn("_any", F.max("_named").over(w))
    out = marked.withColumn("is_overview", F.when(F.col("_any"), F.col("_named")).otherwise(first))
    return out.withColumn("n_overviews", F.count_if("is_overview").over(w)).drop("_named", "_any")


def republished(papers: DataFrame) -> DataFrame:
    return papers.filter(F.col("title").rlike(titles.BEST_OF_LABS))


def _by_tokens(papers: DataFrame) -> DataFrame:
    """SECTION, position, tokens: the title words of each paper, sorted; papers without any are left out."""
    rows = papers.select(*SECTION, "position", titles.title_tokens(F.col("title")).alias("tokens")).filter(F.size("tokens") > 0)
    return rows.groupBy(*SECTION, "position").agg(F.sort_array(F.flatten(F.collect_list("tokens"))).alias("tokens"))  # a position is one row


def best_overview(papers: DataFrame, overviews: DataFrame) -> DataFrame:
    """SECTION, position, overview: the overview that shares most title weight with each paper, if one leads.

    A token weighs one over the number of overviews in the section that have it. Neither side is
    paired with all of the other: they meet by token. Titles of the same words score the same, so each
    set of words is scored once, whatever number of papers and overviews has it; one of several overviews never leads.
    """
    titled = _by_tokens(papers)
    kinds = titled.groupBy(*SECTION, "tokens").agg(F.min("position").alias("kind"))
    told = _by_tokens(overviews).groupBy(*SECTION, "tokens").agg(F.min("position").alias("overview"), F.count("*").alias("copies")).select(*SECTION, "overview", "copies", F.explode("tokens").alias("token"))
    per_token = told.groupBy(*SECTION, "token").agg(F.sum("copies").alias("n"))
    weight = F.when(F.col("n") <= EXACT_UP_TO, F.floor(F.lit(_UNIT) / F.col("n")).cast("decimal(38,9)")).otherwise((F.lit(_UNIT) / F.col("n")).cast("decimal(38,9)"))
    weighted = told.join(per_token, [*SECTION, "token"]).withColumn("weight", weight)
    asked = kinds.select(*SECTION, "kind", F.explode("tokens").alias("token"))
    scores = asked.join(weighted, [*SECTION, "token"]).groupBy(*SECTION, "kind", "overview", "copies").agg(F.sum("weight").alias("score"))
    w = Window.partitionBy(*SECTION, "kind")
    led = scores.withColumn("top", F.max("score").over(w)).filter("score = top").withColumn("ties", F.sum("copies").over(w)).filter("ties = 1")
    return titled.join(kinds, [*SECTION, "tokens"]).join(led, [*SECTION, "kind"]).select(*SECTION, "position", "overview")


def assignments(marked: DataFrame) -> DataFrame:
    """SECTION, position, overview, method: to which overview each other paper belongs."""
    overviews, others = marked.filter("is_overview"), marked.filter("not is_overview")
    alone = overviews.filter("n_overviews = 1").select(*SECTION, F.col("position").alias("overview"))
    by_place = others.filter("n_overviews = 1").join(alone, SECTION).select(*SECTION, "position", "overview", F.lit("section_grouping").alias("method"))
    by_title = best_overview(others.filter("n_overviews > 1"), overviews.filter("n_overviews > 1")).withColumn("method", F.lit("title_heuristic"))
    return by_place.unionByName(by_title)


def build_tasks(papers: DataFrame, extracted_at: Column | str) -> DataFrame:
    """One row for each overview with participants: the nested task record."""
    marked = mark_overviews(papers)
    given = assignments(marked)
    number = titles.task_number(F.col("title"))
    person = F.struct("position", "title", "authors", "pdf_url", titles.team_name(F.col("title")).alias("team_name"), number.alias("number"))
    members = marked.join(given, [*SECTION, "position"]).groupBy(*SECTION, F.col("overview").alias("position"), "method").agg(F.array_sort(F.collect_list(person)).alias("p"))
    rows = marked.filter("is_overview").join(members, [*SECTION, "position"])
    own = titles.task_number(F.col("title"))
    other_task = own.isNotNull() & F.exists("p", lambda x: x["number"].isNotNull() & (x["number"] != own))
    declared = F.size(F.array_distinct(F.filter(F.transform("p", lambda x: x["number"]), lambda n: n.isNotNull())))
    umbrella = F.col("title").rlike(titles.SEVERAL_TASKS) | (declared >= 2)
    confidence = F.when((F.col("method") == "section_grouping") & ~other_task, "high").otherwise("medium")
    venue, name = titles.venue(F.col("section")), titles.task_name(F.col("title"))
    people = F.transform("p", lambda x: F.struct(x["title"].alias("title"), x["authors"].alias("authors"), x["pdf_url"].alias("pdf_url"), x["team_name"].alias("team_name")))
    stamp = F.lit(extracted_at) if isinstance(extracted_at, str) else extracted_at
    return rows.select(
        titles.task_id(F.col("parent_venue"), F.col("year"), venue, name).alias("task_id"), venue.alias("venue"), "parent_venue", "year", name.alias("task_name"), F.col("volume").alias("ceur_volume"),
        F.struct("pdf_url", "title", "authors", umbrella.alias("is_umbrella")).alias("overview"), people.alias("participants"),
        F.struct(F.col("method").alias("task_assignment_method"), confidence.alias("confidence"), stamp.alias("extracted_at")).alias("provenance"),
    )


def by_confidence(tasks: DataFrame, level: str = "high", task_id: str | None = None) -> DataFrame:
    """Tasks of one confidence, or all; with ``task_id`` that one only, whose absence is an error."""
    if level not in (*CONFIDENCE_ORDER, "all"):
        raise ValueError(f"no confidence {level!r}; there are {', '.join([*CONFIDENCE_ORDER, 'all'])}")
    found = tasks if level == "all" else tasks.filter(F.col("provenance.confidence") == level)
    if task_id is None:
        return found
    one = found.filter(F.col("task_id") == task_id)
    if one.isEmpty():
        raise ValueError(f"no task {task_id!r} of confidence {level!r}")
    return one


def join_counts(tasks: DataFrame, counts: DataFrame) -> DataFrame:
    """With ``counts``: papers, claimed teams and runs (task_id, teams, runs), and their ratio, unrounded in ``ratio``."""
    n = F.size("participants")
    ratio = F.when(F.col("teams") != 0, n / F.col("teams"))
    nested = F.struct(n.alias("notebook_papers"), F.col("teams").alias("teams_claimed_in_overview"), F.col("runs").alias("runs_claimed_in_overview"), round_exact(ratio).alias("coverage_ratio"), ratio.alias("ratio"))
    return tasks.join(counts.select("task_id", "teams", "runs"), "task_id", "left").withColumn("counts", nested).drop("teams", "runs")


def participants(tasks: DataFrame) -> DataFrame:
    """A row for each participant, with its task and place."""
    return tasks.select("task_id", F.posexplode("participants").alias("at", "p")).select("task_id", "at", "p.*")


def join_links(people: DataFrame, links: DataFrame) -> DataFrame:
    """Participants with their links (task_id, pdf_url, code_urls, third_party_urls, tira_refs); none are empty lists. Dead links stay."""
    empty = F.array().cast("array<string>")
    details = F.coalesce("code_urls", F.array().cast("array<struct<url:string,status:string,evidence:boolean>>"))
    joined = people.join(links, ["task_id", "pdf_url"], "left")
    return joined.withColumn("code_url_details", details).withColumn("code_urls", F.transform("code_url_details", lambda x: x["url"])).withColumn("third_party_urls", F.coalesce("third_party_urls", empty)).withColumn("tira_refs", F.coalesce("tira_refs", empty))


def last_records(manifest: DataFrame, key: str = "pdf_url", order: str = "ord") -> DataFrame:
    """Of each key the last record."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return manifest.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def join_fulltext(documents: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Documents by pdf_url with where their text, figures and tables are. Without a manifest nothing is added."""
    if manifest is None:
        return documents
    found = last_records(manifest).select("pdf_url", F.col("markdown_path").alias("fulltext_path"), "figures_dir", "n_figures", "tables_dir", "n_tables")
    return documents.join(found, "pdf_url", "left").na.fill(0, ["n_figures", "n_tables"])


def upsert(old: DataFrame, new: DataFrame, key: str = "pdf_url") -> DataFrame:
    """Records of ``old`` with those of ``new`` in their place or besides."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def retry(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents whose record asks for another parse; all of them if none does."""
    again = manifest.filter("needs_ocr").select("pdf_url")
    return documents if again.isEmpty() else documents.join(again, "pdf_url", "left_semi")


def ranking(ratio: Column, confidence: Column, umbrella: Column, n: Column, tie: Column) -> list[Column]:
    """Known ratios first and largest first, then confidence, single tasks, more participants, input order."""
    level = F.coalesce(*[F.when(confidence == c, F.lit(i)) for c, i in CONFIDENCE_ORDER.items()], F.lit(9))
    return [ratio.isNull().asc(), ratio.desc_nulls_last(), level.asc(), umbrella.asc(), n.desc(), tie.asc()]


def select_corpus(tasks: DataFrame, target: int = TARGET, tie: str = "task_id") -> DataFrame:
    """The first ``target`` tasks in the order of the corpus."""
    order = ranking(F.col("counts.coverage_ratio"), F.col("provenance.confidence"), F.col("overview.is_umbrella"), F.size("participants"), F.col(tie))
    return tasks.orderBy(*order).limit(target)


def candidate_problems(tasks: DataFrame, most: int = 20) -> DataFrame:
    """rule, subject: what is wrong with candidates before they have counts. It is logged, ``most`` of it, and stops nothing."""
    found = violations(tasks.withColumn("counts", F.struct(F.lit(None).cast("double").alias("coverage_ratio"))))
    for row in found.orderBy("rule", "subject").limit(most).collect():
        log.error("%s: %s", row["rule"], row["subject"])
    return found


def violations(tasks: DataFrame) -> DataFrame:
    """rule, subject: what must not be in a corpus. It is written only if there is nothing here."""
    rule = lambda name, df, column: df.select(F.lit(name).alias("rule"), F.col(column).alias("subject"))
    urls = tasks.select("task_id", F.explode(F.concat(F.array("overview.pdf_url"), F.transform("participants", lambda p: p["pdf_url"]))).alias("url"))
    shared = urls.groupBy("url").agg(F.count_distinct("task_id").alias("n")).filter("n > 1")
    ratio = F.col("counts.coverage_ratio")
    return (
        rule("no participants", tasks.filter(F.size("participants") == 0), "task_id")
        .unionByName(rule("duplicate task_id", tasks.groupBy("task_id").count().filter("count > 1"), "task_id"))
        .unionByName(rule("pdf_url in several tasks", shared, "url"))
        .unionByName(rule("coverage_ratio out of bounds", tasks.filter(~ratio.between(*RATIO_BOUNDS)), "task_id"))
    )


def spot_check(tasks: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    """A few tasks, the same ones for a seed."""
    return tasks.orderBy(F.xxhash64(F.lit(seed), "task_id")).limit(n)


def venue_year_report(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("parent_venue", "year").agg(F.count("*").alias("tasks"))


def corpus_report(tasks: DataFrame, people: DataFrame) -> DataFrame:
    """One row with the figures of a corpus and its links; ``people`` as from ``join_links``."""
    of_tasks = tasks.agg(
        F.count("*").alias("tasks"), F.count("counts.coverage_ratio").alias("known_ratios"), F.round(F.avg("counts.coverage_ratio"), 3).alias("mean_ratio"), F.count_if("overview.is_umbrella").alias("umbrellas")
    )
    status = lambda kind: F.coalesce(F.sum(F.size(F.filter("code_url_details", lambda d: link_class(d["status"]) == kind))), F.lit(0))
    of_people = people.agg(
        F.count("*").alias("participants"), F.count("team_name").alias("named_teams"), F.count_if((F.size("code_urls") > 0) | (F.size("tira_refs") > 0)).alias("with_code"),
        F.coalesce(F.sum(F.size("code_url_details")), F.lit(0)).alias("code_urls"), status("live").alias("live"), status("dead").alias("dead"), status("unverified").alias("unverified"),
        F.coalesce(F.sum(F.size(F.filter("code_url_details", lambda d: d["evidence"]))), F.lit(0)).alias("evidenced"), F.coalesce(F.sum(F.size("third_party_urls")), F.lit(0)).alias("third_party"),
    )
    return of_tasks.crossJoin(F.broadcast(of_people))  # one row each


def flat(tasks: DataFrame, people: DataFrame, overview_paths: DataFrame | None = None) -> DataFrame:
    """The 24 columns of the flat export, lists joined by "; ". ``people`` as from ``join_links``, with fulltext_path if known."""
    path = F.col("fulltext_path") if "fulltext_path" in people.columns else F.lit(None).cast("string")
    union = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), "; ")
    live = F.transform(F.filter("code_url_details", lambda d: d["status"] == "200"), lambda d: d["url"])
    per_task = people.groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "pdf_url", F.coalesce(path, F.lit("")).alias("path")))).alias("_p"), F.array_join(F.array_sort(F.collect_set("team_name")), "; ").alias("team_names"),
        union(F.col("code_urls")).alias("code_urls"), union(live).alias("code_urls_live"), union(F.col("tira_refs")).alias("tira_refs"),
    )
    paths = overview_paths.select(F.col("pdf_url").alias("_url"), F.col("fulltext_path").alias("_path")) if overview_paths is not None else None
    rows = tasks.join(per_task, "task_id", "left")
    rows = rows.join(paths, F.col("overview.pdf_url") == F.col("_url"), "left") if paths is not None else rows.withColumn("_path", F.lit(None).cast("string"))
    made = {
        "overview_title": F.col("overview.title"), "overview_pdf_url": F.col("overview.pdf_url"), "overview_authors": F.array_join("overview.authors", "; "), "is_umbrella": F.col("overview.is_umbrella"),
        **{c: F.col(f"counts.{c}") for c in ("notebook_papers", "teams_claimed_in_overview", "runs_claimed_in_overview", "coverage_ratio")},
        "participant_pdf_urls": F.array_join(F.transform("_p", lambda x: x["pdf_url"]), "; "), "participant_fulltext_paths": F.array_join(F.transform("_p", lambda x: x["path"]), "; "),
        "overview_fulltext_path": F.coalesce("_path", F.lit("")), **{c: F.col(f"provenance.{c}") for c in ("task_assignment_method", "confidence", "extracted_at")},
    }
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in CSV_COLUMNS])
