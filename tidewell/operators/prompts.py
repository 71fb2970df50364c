"""Prompts with their fall-backs, and the scoring of queued articles by models that the caller gives.

A model is a function from rows with a ``prompt``, ``temperature`` and ``model`` to the same
rows with a ``response`` (null: the call failed); it may be a Pandas UDF around any service.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions import text
from tidewell.operators import changes, readers, shelf
from tidewell.plans.scratch import broadcast_if_small, materialize
from tidewell.sources.star import Star, conform

#: Temperatures that hold without any setting; fixed values.
TEMPERATURES = {"security": 0.3, "curation": 0.5, "summarization": 0.3, "group_summary": 0.5, "related_groups": 0.3, "newsletter": 0.6}
#: Own short defaults; callers pass theirs.
DEFAULTS = {
    "security": "Is this article safe to show? Answer as JSON with safe, score (0 to 10) and reasoning.\nTitle: {{.Title}}\n{{.Content}}",
    "curation": "How interesting is this article to a reader of {{.Keywords}}? Answer as JSON with interest_score (0 to 10) and reasoning.\nTitle: {{.Title}}\n{{.Content}}",
    "summarization": "Summarise this article in at most {{.MaxSummaryLength}} characters.\nTitle: {{.Title}}\n{{.Content}}",
    "group_summary": "Write a headline and a summary of these articles as JSON with headline and summary.\nTopic: {{.Topic}}\n{{.Articles}}",
    "related_groups": "Which of these groups is the article about? Answer as JSON with group_id.\nTitle: {{.Title}}\n{{.Groups}}",
    "newsletter": "Write an issue of {{.Name}} as JSON with headline and body.\n{{.Articles}}",
}
#: Bytes of an article that models see; the same for all, so that nothing goes unchecked.
MAX_CONTENT = 3000
SECURITY, CURATION = "safe BOOLEAN, score DOUBLE, reasoning STRING", "interest_score DOUBLE, reasoning STRING"
#: What users are asked about each queued article.
VOICED = ["security", "summarization", "curation"]
Model = Callable[[DataFrame], DataFrame]


def effective(s: Star, config: dict[str, dict] | None = None) -> DataFrame:
    """(user_id, prompt_type, prompt, temperature, model, customized) of every user and type.

    A prompt and a model come from the user, else from user 0, else from ``config``, else from
    the defaults; a temperature from the user, else from ``config``, else from the defaults.
    """
    config = config or {}
    rows = [(k, config.get(k, {}).get("prompt") or DEFAULTS[k], config.get(k, {}).get("temperature") or t, config.get(k, {}).get("model") or "") for k, t in TEMPERATURES.items()]
    base = s.spark.createDataFrame(rows, "prompt_type string, base_prompt string, base_temperature double, base_model string")
    own = s["user_prompts"].select("user_id", "prompt_type", "prompt_template", "temperature", "model")
    admin = own.where("user_id = 0").select("prompt_type", F.col("prompt_template").alias("admin_prompt"), F.col("model").alias("admin_model"))
    each = s["users"].select(F.col("id").alias("user_id")).join(F.broadcast(base.join(admin, "prompt_type", "left")))  # six rows
    joined = each.join(own, ["user_id", "prompt_type"], "left")

    def first(*columns: str) -> Column:
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))

    return joined.select(
        "user_id", "prompt_type", first("prompt_template", "admin_prompt", "base_prompt").alias("prompt"),
        F.when(F.col("temperature") > 0, F.col("temperature")).otherwise(F.col("base_temperature")).alias("temperature"),
        first("model", "admin_model", "base_model").alias("model"), (first("prompt_template") != "").alias("customized"),
    )


def set_prompts(s: Star, requests: DataFrame, now: str) -> Star:
    """Prompts (user_id, prompt_type, prompt_template, temperature, model) of types that users may set; a null model keeps the old one."""
    rows = requests.where(F.col("prompt_type").isin(changes.PROMPT_TYPES))
    old = s["user_prompts"].select("user_id", "prompt_type", F.col("model").alias("old_model"), F.col("created_at").alias("old_created"))
    at = F.lit(now).cast("timestamp_ntz")
    rows = rows.join(old, ["user_id", "prompt_type"], "left").withColumns({"model": F.coalesce("model", "old_model"), "created_at": F.coalesce("old_created", at), "updated_at": at})
    return changes.store(s, "user_prompts", rows)


def reset_prompts(s: Star, keys: DataFrame) -> Star:
    """The prompts of (user_id, prompt_type) are the defaults again."""
    return changes.forget(s, "user_prompts", keys.select("user_id", "prompt_type"))


def rendered(template: Column, **values: Column) -> Column:
    """A template with its ``{{.Name}}`` places filled; what values hold is not filled again."""
    parts = F.split(template, r"\{\{ *", -1)

    def fill(x: Column, i: Column) -> Column:
        out = F.concat(F.lit("{{"), x)
        for name, value in values.items():
            end = rf"^\.{name} *\}}\}}"
            out = F.when(x.rlike(end), F.concat(F.coalesce(value.cast("string"), F.lit("")), F.regexp_replace(x, end, ""))).otherwise(out)
        return F.when(i == 0, x).otherwise(out)

    return F.array_join(F.transform(parts, fill), "")


def contents(s: Star) -> DataFrame:
    """(id, title, content): the content, else the summary, and what is linked."""
    body = F.coalesce(F.nullif("content", F.lit("")), F.coalesce("summary", F.lit("")))
    linked = F.when(F.coalesce("linked_content", F.lit("")) != "", F.concat(F.lit("\n\n"), "linked_content")).otherwise("")
    return s["articles"].select("id", "title", F.concat(body, linked).alias("content"))


def content_of(s: Star, rows: DataFrame) -> DataFrame:
    """Rows (user_id, id, ...) with title and content."""
    return rows.select("user_id", "id").join(contents(s), "id")


def asked(s: Star, rows: DataFrame, kind: str, model: Model, config: dict | None = None, askers: DataFrame | None = None, **values: Column) -> DataFrame:
    """Rows (user_id, id, title, content) with the model's response to the user's prompt of a kind.

    ``askers`` (user_id, ...) are the users of the rows, where these are known to be few: their prompts, and what else stands with
    them, go to the rows, so that contents are not shuffled by user.
    """
    prompts = effective(s, config).where(F.col("prompt_type") == kind).select("user_id", "prompt", "temperature", "model")
    if askers is not None:
        prompts = broadcast_if_small(askers.join(prompts, "user_id"))
    filled = rendered(F.col("prompt"), Title=F.col("title"), Content=text.truncate_bytes(F.col("content"), MAX_CONTENT), **values)
    return model(rows.join(prompts, "user_id").withColumn("prompt", filled))


def read_json(response: Column, schema: str) -> Column:
    return F.from_json(text.extract_json(response), schema)


def good_summary(summary: Column, most: int, longest: Column) -> Column:
    """A summary that is no garbage, no longer than the article's bytes, and at most 15 % over the limit."""
    size = F.octet_length(summary)
    return (summary != "") & ~text.is_garbage(summary) & (size <= longest) & (F.lit(most <= 0) | (size <= most + most * 15 // 100))


def voices(s: Star, config: dict | None = None) -> DataFrame:
    """(user_id, voice, security, summarization, curation): for each kind the least user who asks a model the same.

    Users ask the same where prompt, temperature, model and, for curation, keywords are equal;
    ``voice`` is the least user who asks the same of every kind.
    """
    words = keywords(s)
    out = s["users"].select(F.col("id").alias("user_id"))
    for kind in VOICED:
        own = effective(s, config).where(F.col("prompt_type") == kind).join(words, "user_id")
        same = ["prompt", "temperature", "model"] + (["keywords"] if kind == "curation" else [])
        out = out.join(own.join(own.groupBy(same).agg(F.min("user_id").alias(kind)), same).select("user_id", kind), "user_id")
    return out.join(out.groupBy(VOICED).agg(F.min("user_id").alias("voice")), VOICED)


def keywords(s: Star) -> DataFrame:
    words = F.when(F.size("keywords") > 0, F.array_join("keywords", ", ")).otherwise("No specific preferences")
    return shelf.preferences(s).select("user_id", words.alias("keywords"))


def waiting(subs: DataFrame, articles: DataFrame, done: DataFrame, have: DataFrame) -> DataFrame:
    """(voice, id, feed_id, bare): articles (id, feed_id) queued for some user of a voice; bare: for one without a summary.

    Found by counting: subscribers of the feed less those who are done, and less those who have a summary.
    """
    few, key = readers.light(articles.distinct()), ["voice", "feed_id", "id"]
    readers_of = subs.groupBy("voice", "feed_id").agg(F.count(F.lit(1)).alias("n"))

    def of_voice(pairs: DataFrame, name: str) -> DataFrame:
        rows = pairs.join(few, "id").join(subs, ["user_id", "feed_id"])
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))

    gone = of_voice(done, "gone")
    held = of_voice(have.join(done, ["user_id", "id"], "left_anti"), "held")
    rows = readers_of.join(few, "feed_id").join(gone, key, "left").join(held, key, "left")
    left = F.col("n") - F.coalesce("gone", F.lit(0))
    return rows.where(left > 0).select("voice", "id", "feed_id", (left > F.coalesce("held", F.lit(0))).alias("bare"))


def process(s: Star, security: Model, curation: Model, summarization: Model, keep: Callable[[DataFrame, str], DataFrame], min_security: float = 7.0, min_length: int = 0, most: int = 500, config: dict | None = None) -> Star:
    """The star after all queued articles of all users were looked at once (``looked``)."""
    rows, replaced, fresh = looked(s, security, curation, summarization, keep, min_security, min_length, most, config)
    summaries = s["article_summaries"].unionByName(conform(fresh, "article_summaries"))  # of pairs that have none
    return s.replace(read_state=changes.without(s["read_state"], replaced).unionByName(rows), article_summaries=summaries)


def looked(s: Star, security: Model, curation: Model, summarization: Model, keep: Callable[[DataFrame, str], DataFrame], min_security: float = 7.0, min_length: int = 0, most: int = 500, config: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New rows of reading state, the rows (user_id, article_id) that they replace, and new summaries, of all queued articles of all users.

    Too short: scored zero.  Unsafe, or an answer that is no JSON: interest zero.  A failed call
    counts as a retry.  Safe ones are summarised where they have no summary, and scored.
    ``keep`` writes a table and reads it again, so that no model is called twice for a row.

    A model is asked once about an article for all users whose questions are equal word for
    word (``voices``), in the name of the least of them, and all of them get its answer.  So
    what is written grows with articles times different questions; users times articles are
    listed only as the rows of the result, without a shuffle or a join.  Who subscribes but is no user is
    not asked for.
    """
    users = keep(voices(s, config), "voices")
    subs = keep(s["user_feeds"].select("user_id", "feed_id").join(broadcast_if_small(users.select("user_id", "voice")), "user_id"), "voiced")
    done, have = shelf.scored(s), shelf.summarized(s)
    articles = s["articles"].select("id", "feed_id")
    queue = keep(waiting(subs, articles, done, have), "queue")
    kinds = broadcast_if_small(users.where("user_id = voice").select("voice", *VOICED))

    def ask(rows: DataFrame, kind: str, model: Model, *columns: str | Column, **values: Column) -> DataFrame:
        once = content_of(s, rows.select(F.col(kind).alias("user_id"), "id").distinct())
        askers = kinds.select(F.col(kind).alias("user_id")).distinct()
        if kind == "curation":
            askers = askers.join(keywords(s), "user_id")
        answers = asked(s, once, kind, model, config, askers, **values)
        return keep(answers.select(F.col("user_id").alias(kind), "id", *columns), kind)

    sizes = contents(s).select("id", (F.octet_length("content") < min_length).alias("short"))
    rows = queue.join(kinds, "voice").join(sizes, "id")
    checked = ask(rows.where(~F.col("short")), "security", security, "response")
    verdict = checked.withColumn("v", read_json(F.col("response"), SECURITY))
    safe = F.coalesce(F.col("v.safe"), F.lit(False)) & (F.coalesce("v.score", F.lit(0.0)) >= min_security)
    verdict = verdict.select(
        "security", "id", F.col("response").isNull().alias("silent"), safe.alias("safe"),
        F.when(safe, F.col("v.score")).otherwise(F.coalesce("v.score", F.lit(0.0))).alias("security_score"),
        F.when(safe, F.col("v.reasoning")).otherwise(F.coalesce("v.reasoning", F.lit("unreadable answer"))).alias("security_reason"),
    )
    judged = rows.join(verdict, ["security", "id"], "left").withColumn("silent", ~F.col("short") & F.coalesce("silent", F.lit(True)))
    passed = judged.where(~F.col("short") & ~F.col("silent") & F.col("safe"))
    written = ask(passed.where("bare"), "summarization", summarization, F.trim("response").alias("ai_summary"), F.octet_length("content").alias("longest"), MaxSummaryLength=F.lit(most))
    curated = ask(passed, "curation", curation, F.col("response").alias("opinion"), Keywords=F.col("keywords"))
    interest = F.coalesce(read_json(F.col("opinion"), CURATION)["interest_score"], F.lit(0.0))
    found = judged.join(curated, ["curation", "id"], "left")
    short, failed = F.col("short"), F.col("silent") | (F.col("safe") & F.col("opinion").isNull())
    zero = F.lit(0.0)
    outcome = found.select(
        "voice", "feed_id", "id", F.coalesce(~short & failed, F.lit(False)).alias("failed"),
        F.when(short | ~F.col("safe"), zero).otherwise(interest).alias("interest"),
        F.when(short, zero).otherwise(F.col("security_score")).alias("security"), F.when(short, "content too short").otherwise(F.col("security_reason")).alias("reason"),
    )
    rows, replaced = changes.looked_at(s, subs, keep(outcome, "outcome"), done)
    good = passed.join(written.where(good_summary(F.col("ai_summary"), most, F.col("longest"))), ["summarization", "id"]).select("voice", "feed_id", "id", "ai_summary")
    fresh = readers.left_over(subs, articles, done.union(have).distinct(), keep(good, "good"), ["voice"])
    return rows, replaced, fresh.select("user_id", F.col("id").alias("article_id"), "ai_summary")


def cluster_prompt(articles: DataFrame, most: int = 200) -> DataFrame:
    """(user_id, prompt): numbered titles with scores of (user_id, place, title, score), for grouping by a model.

    A prompt holds a user's ``most`` first places; a model reads no more at once.
    """
    best = Window.partitionBy("user_id").orderBy("place", "title", "score")
    articles = articles.withColumn("nr", F.row_number().over(best)).where(F.col("nr") <= most)
    line = F.format_string("%d. [%.1f] %s", "place", "score", "title")
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    head = "Group these articles by the event or topic they cover. Answer as JSON: groups, each with topic and article_indices.\n\n"
    return articles.groupBy("user_id").agg(F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("prompt"))


def clusters(answers: DataFrame) -> DataFrame:
    """(user_id, topic, place) of answers (user_id, response) to such prompts; the first group of a place counts."""
    groups = read_json(F.col("response"), "groups ARRAY<STRUCT<topic: STRING, article_indices: ARRAY<INT>>>")["groups"]
    rows = answers.select("user_id", F.posexplode(groups).alias("g", "group")).select("user_id", "g", "group.topic", F.explode("group.article_indices").alias("place"))
    return rows.groupBy("user_id", "place").agg(F.min_by("topic", "g").alias("topic")).select("user_id", "topic", "place")


def group_descriptions(s: Star) -> DataFrame:
    """(user_id, group_id, line): topic, first titles and summary of each group, for matching by a model."""
    heads = s["article_groups"].select(F.col("id").alias("group_id"), "user_id", "topic")
    rows = heads.join(shelf.first_titles(s), "group_id").join(s["group_summaries"].select("group_id", "summary"), "group_id", "left")
    tail = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("\n  Summary: "), text.truncate_bytes(F.col("summary"), 300))).otherwise("")
    titles = F.replace(F.col("titles"), F.lit(" | "), F.lit("\n  - "))
    return rows.select("user_id", "group_id", F.concat(F.format_string("Group %d - %s:\n  Articles:\n  - ", "group_id", "topic"), titles, tail).alias("line"))


def refined_topics(answers: DataFrame) -> DataFrame:
    """(id, topic): trimmed answers of at most 200 bytes."""
    return answers.select("id", text.cut_bytes(F.trim("response"), 200).alias("topic"))


def newsletter_inputs(s: Star, letters: DataFrame) -> DataFrame:
    """(newsletter_id, rank, id, title, feed_title, url, score, summary, categories): what an issue is written from."""
    rows = shelf.issue_articles(s, letters).join(letters.select(F.col("id").alias("newsletter_id"), "user_id"), "newsletter_id")
    own = s["article_summaries"].select("user_id", F.col("article_id").alias("id"), "ai_summary")
    names = s["article_categories"].groupBy(F.col("article_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    feeds = s["feeds"].select(F.col("id").alias("feed_id"), F.col("title").alias("feed_title"))
    rows = rows.join(s["articles"].select("id", "feed_id", "title", "url", "summary"), "id").join(own, ["user_id", "id"], "left").join(names, "id", "left").join(feeds, "feed_id", "left")
    return rows.select(
        "newsletter_id", "rank", "id", "title", "feed_title", "url", F.col("interest_score").alias("score"),
        F.coalesce("ai_summary", F.nullif("summary", F.lit("")), F.lit("")).alias("summary"), F.coalesce("categories", F.lit("")).alias("categories"),
    )


def write_issues(s: Star, letters: DataFrame, model: Model, now: str, keep: Callable[[DataFrame, str], DataFrame] = materialize) -> Star:
    """Issues of all the given newsletters that have articles, written by a model; failed ones stay due.

    The answers are written once (``keep``): ids, headlines and lists of the result are read
    from the same ones, and no later action calls the model again.
    """
    inputs = newsletter_inputs(s, letters)
    line = F.format_string("- %s (%s, %.1f): %s", "title", F.coalesce("feed_title", F.lit("")), "score", "summary")
    lists = inputs.groupBy(F.col("newsletter_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", line.alias("line")))).alias("l"))  # at most max_articles rows each
    rows = lists.join(letters.select(F.col("id").alias("newsletter_id"), "name", F.coalesce("prompt_template", F.lit(DEFAULTS["newsletter"])).alias("template")), "newsletter_id")
    filled = rendered(F.col("template"), Name=F.col("name"), Articles=F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    answers = model(rows.withColumns({"prompt": filled, "temperature": F.lit(TEMPERATURES["newsletter"]), "model": F.lit("")}))
    answers = keep(answers, "issues")
    read = answers.withColumn("r", read_json(F.col("response"), "headline STRING, body STRING")).where("r.headline IS NOT NULL")
    issues = read.select("newsletter_id", F.col("r.headline").alias("headline"), F.col("r.body").alias("content_html"), F.transform("l", lambda x: x["id"]).alias("article_ids"))
    return changes.add_issues(s, issues, now)


# --- vectors ---------------------------------------------------------------------

#: Bytes of content below which an article has no vector, and bytes of text that a model sees; fixed values.
LEAST_EMBEDDED, MOST_EMBEDDED = 200, 7500


def embedding_text(title: Column, content: Column) -> Column:
    """Title and content as a model is given them, in whole characters; null where the content is too short."""
    whole = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), content)
    return F.when(F.octet_length(content) >= LEAST_EMBEDDED, text.cut_bytes(whole, MOST_EMBEDDED))


def backfill_embeddings(s: Star, embed: Model, model: str, now: str, keep: Callable[[DataFrame, str], DataFrame] = materialize) -> Star:
    """Vectors of all articles that the model has none of.

    ``embed`` turns rows (id, text) into rows with an ``embedding``.  What is too short, or
    gets no vector, is stored with an empty one, so that it is not asked about again.
    """
    missing = shelf.without_embeddings(s, model).select("id").join(s["articles"].select("id", "title", "content", "summary"), "id")
    content = F.coalesce(F.nullif("content", F.lit("")), "summary")
    rows = missing.select("id", embedding_text(F.col("title"), content).alias("text"))
    made = keep(embed(rows.where("text IS NOT NULL")).select("id", "embedding"), "embeddings")
    every = rows.select("id").join(made, "id", "left")
    vectors = every.select(F.col("id").alias("article_id"), F.coalesce(F.col("embedding").cast("array<float>"), F.array().cast("array<float>")).alias("embedding"))
    return changes.store(s, "article_embeddings", vectors.withColumns({"embedding_model": F.lit(model), "created_at": F.lit(now).cast("timestamp_ntz")}))
