"""One query per operator over the whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from labelmill import fixed_values as fixed
from labelmill.functions import names, prompts, text
from labelmill.operators import dialogs, metrics, positions, runs, sampling, scoring, tables
from labelmill.plans.flatten import sample_segments
from labelmill.plans.predict import predict_posts
from labelmill.plans.evaluate import evaluate_tree
from labelmill.settle import settle, shared_folder
from labelmill.sinks import versions, writers
from labelmill.sources import readers
from labelmill.sources.readers import read_parquet, spread
from labelmill.streaming import runs as arriving

Query = Callable[[SparkSession, str], DataFrame]

# Function words that tell the four languages of the documents apart.
WORDS = {"the": "en", "of": "en", "and": "en", "le": "fr", "les": "fr", "et": "fr", "der": "de", "die": "de",
         "und": "de", "el": "es", "los": "es", "y": "es"}
LANGUAGES = ("en", "fr", "de", "es")
SEPARATOR = "\n"
LIMIT = 100

_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """The documents spread over the cores, for costly work on their texts."""
    return spread(documents(spark, folder), "doc_id")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").withColumnsRenamed({"conv_id": "conv_no", "role": "speaker"})


def marker_table(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as a flat table whose only order is ``row_id``, each one led by a marker row."""
    turns = conversations(spark, folder)
    rows = turns.select("conv_no", "turn", "speaker", "text")
    markers = turns.groupBy("conv_no").agg(F.lit(-1).cast("long").alias("turn")).select(
        "conv_no", "turn", names.marker_name(F.col("conv_no")).alias("speaker"), F.lit("").alias("text")
    )
    return positions.row_ids(rows.unionByName(markers), ["conv_no", "turn"]).select("row_id", "speaker", "text")


def nested(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as conversation records: each line is an utterance, its first letter stands for the speaker."""
    speaker = lambda line: F.nullif(F.lower(F.substring(line, 1, 1)), F.lit(""))
    lines = F.transform(
        F.split("text", SEPARATOR, -1), lambda line: F.struct(speaker(line).alias("speaker"), line.alias("utterance"))
    )
    return texts(spark, folder).select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("filename"), lines.alias("conversation")
    )


def first_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation records cut to their first utterance."""
    first = F.array(F.struct("speaker", F.col("text").alias("utterance"))).alias("conversation")
    return conversations(spark, folder).where(F.col("turn") == 0).select(F.col("conv_no").alias("row_id"), first)


def pack(value: Column) -> Column:
    return text.pack_paragraphs(value, LIMIT, SEPARATOR)


def language(answer: Column, mode: str = "word", trim: bool = True) -> Column:
    return tables.map_values(text.first_label(answer, list(WORDS), mode, trim), WORDS)


def rule_columns() -> dict[str, Column]:
    """Four labelling rules; each one stands for a model run."""
    body = F.col("text")
    return {
        "word": language(body),
        "whitespace": language(body, "whitespace"),
        "bare": language(body, "whitespace", False),
        "substring": language(body, "substring"),
    }


def rated(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder).select("doc_id", "lang", "source", *[v.alias(k) for k, v in rule_columns().items()])


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, row_id, model_id, generation_config, said) for every rule."""
    rules = F.array(*[F.struct(F.lit(name).alias("model_id"), F.col(name).alias("said")) for name in rule_columns()])
    return rated(spark, folder).select(
        F.col("source").alias("dataset"), F.col("doc_id").alias("row_id"), F.lit("words=12").alias("generation_config"),
        F.inline(rules),
    )


def gold(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        F.col("source").alias("dataset"), F.col("doc_id").alias("row_id"), F.col("lang").alias("gold")
    )


def all_reports(spark: SparkSession, folder: str) -> DataFrame:
    targets = {"language": ("gold", "said", LANGUAGES), "without_es": ("gold", "said", LANGUAGES[:3])}
    return runs.evaluate_runs(predictions(spark, folder), gold(spark, folder), targets)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 10) for name in columns})


def digest(value: Column) -> Column:
    return F.md5(value)


# text -----------------------------------------------------------------------------------------------------------------


@query
def mask_mentions(spark, folder):
    return documents(spark, folder).select("doc_id", text.mask_mentions(F.col("text")).alias("text"))


@query
def token_count(spark, folder):
    body = F.col("text")
    return texts(spark, folder).select(
        "doc_id", text.token_count(body).alias("tokens"), text.is_lengthy(body, LIMIT).cast("long").alias("is_lengthy")
    )


@query
def pack_paragraphs(spark, folder):
    segments = texts(spark, folder).select("doc_id", F.posexplode(pack(F.col("text"))).alias("seg", "text"))
    return segments.select("doc_id", F.col("seg").cast("long").alias("seg"), "text", text.token_count(F.col("text")).alias("tokens"))


@query
def pack_sentences(spark, folder):
    packed = text.pack_sentences(F.col("text"), LIMIT)
    segments = texts(spark, folder).select("doc_id", F.posexplode(packed).alias("seg", "text"))
    return segments.select("doc_id", F.col("seg").cast("long").alias("seg"), "text")


@query
def pack_sentences_with_empty_head(spark, folder):
    packed = text.pack_sentences(F.col("text"), 20, keep_empty=True)
    segments = texts(spark, folder).select("doc_id", F.posexplode(packed).alias("seg", "text"))
    return segments.select("doc_id", F.col("seg").cast("long").alias("seg"), "text")


@query
def first_label_word(spark, folder):
    return texts(spark, folder).select("doc_id", text.first_label(F.col("text"), list(WORDS)).alias("label"))


@query
def first_label_whitespace(spark, folder):
    label = text.first_label(F.col("text"), list(WORDS), "whitespace")
    return texts(spark, folder).select("doc_id", label.alias("label"))


@query
def first_label_bare(spark, folder):
    label = text.first_label(F.col("text"), list(WORDS), "whitespace", trim_punctuation=False)
    return texts(spark, folder).select("doc_id", label.alias("label"))


@query
def label_by_substring(spark, folder):
    label = text.label_by_substring(F.col("text"), ("ing", "ment", "ung"))
    return documents(spark, folder).select("doc_id", label.alias("label"))


@query
def strip_echo(spark, folder):
    prompt = F.concat(F.lit("<"), F.col("source"), F.lit("> ="))
    raw = F.concat(prompt, F.lit(" "), F.col("text"))
    return documents(spark, folder).select(
        "doc_id",
        text.strip_echo(F.col("text"), ". ").alias("after_stop"),
        text.strip_echo(raw, prompt).alias("after_prompt"),
    )


# prompts --------------------------------------------------------------------------------------------------------------


def _prompts(spark, folder, **options):
    columns = prompts.prompt_columns(F.col("text"), **options)
    return texts(spark, folder).select("doc_id", *[digest(value).alias(name) for name, value in columns.items()])


@query
def prompt_zero_shot(spark, folder):
    return _prompts(spark, folder, shots=0)


@query
def prompt_few_shot(spark, folder):
    return _prompts(spark, folder, shots=True)


@query
def prompt_one_example(spark, folder):
    return _prompts(spark, folder, shots=1)


@query
def prompt_roles(spark, folder):
    return _prompts(spark, folder, shots=True, roles=True)


@query
def chat_messages(spark, folder):
    messages = prompts.chat_messages(prompts.task_context("emotion", 0), prompts.build_prompt(F.col("text"), ""))
    turns = documents(spark, folder).select("doc_id", F.posexplode(messages).alias("pos", "message"))
    return turns.select("doc_id", F.col("pos").cast("long").alias("pos"), "message.role", digest(F.col("message.content")).alias("content"))


@query
def headline_prompt(spark, folder):
    return documents(spark, folder).select(
        "doc_id",
        digest(prompts.headline_prompt(F.col("text"), F.col("lang"))).alias("training"),
        digest(prompts.headline_prompt(F.col("text"))).alias("testing"),
    )


@query
def label_context(spark, folder):
    seen = prompts.label_names([(documents(spark, folder), "lang"), (conversations(spark, folder), "speaker")])
    single = prompts.fill_labels(fixed.SENTIMENT_TEMPLATE, {"labels": seen})
    pair = prompts.fill_labels(
        fixed.EMOTION_SENTIMENT_TEMPLATE,
        {"emotion_labels": prompts.label_names([(documents(spark, folder), "lang")]), "sentiment_labels": "yes or no"},
    )
    body = F.col("text")
    return documents(spark, folder).select(
        "doc_id",
        digest(prompts.build_prompt(body, single, prompts.TRAINING_WRAP)).alias("single"),
        digest(prompts.build_prompt(body, pair, prompts.TRAINING_WRAP)).alias("pair"),
    )


@query
def training_table(spark, folder):
    posts = documents(spark, folder).withColumnsRenamed({"lang": "voted_emotion", "source": "voted_sentiment"})
    labelled = tables.labelled_table(posts, keep=["doc_id"])
    ready = tables.training_table(labelled, "emotion")
    return ready.select("doc_id", digest(F.col("text")).alias("text"), "label", "sentiment")


# names and flags ------------------------------------------------------------------------------------------------------


@query
def dataset_name(spark, folder):
    return table(spark, folder, "pages").select("page_id", names.dataset_name(F.col("url")).alias("dataset"))


@query
def parse_flag(spark, folder):
    worded = F.when(F.col("quality") == 1, "Yes").otherwise("f")
    return table(spark, folder, "labels").select(
        "doc_id",
        names.parse_flag(worded).alias("quality"),
        names.parse_flag(F.col("toxic")).alias("toxic"),
        names.parse_flag(F.replace(worded, F.lit("f"), F.lit("maybe")), strict=False).cast("string").alias("lenient"),
    )


@query
def run_folder(spark, folder):
    flags = table(spark, folder, "labels").join(documents(spark, folder), "doc_id")
    name = names.generation_config(
        F.col("n_chars"), F.lit("0.01"), F.lit("1.05"), F.col("quality") == 1, F.col("toxic") == 1, F.col("lang") == "en"
    )
    return flags.select("doc_id", name.alias("config"), names.conversation_id(F.col("source"), F.col("doc_id").cast("string")).alias("id"))


# flat tables ----------------------------------------------------------------------------------------------------------


@query
def select_rename_blank(spark, folder):
    df = documents(spark, folder).withColumn("copy", F.col("source")).withColumnRenamed("n_chars", "size").drop("text")
    return tables.fill_text(tables.blank(df, ["source"]).withColumn("lang", F.nullif("lang", F.lit("es"))), "lang")


@query
def filter_missing_text(spark, folder):
    rows = conversations(spark, folder).select(
        "conv_no", "turn",
        F.when(F.col("speaker") != "system", F.concat(F.lit("SPEAKER_"), "speaker")).alias("speaker"),
        F.when(F.col("speaker") != "user", F.col("text")).alias("text"),
    )
    kept = tables.drop_empty_speaker_rows(rows)
    return tables.with_text(kept).unionByName(tables.without_rating(rows, "text").withColumn("text", F.lit("none")))


@query
def stratum_counts(spark, folder):
    rows = texts(spark, folder).select(
        "doc_id", tables.stratum_by_name(F.col("source"), "src1").alias("stratum"), F.explode(pack(F.col("text"))).alias("text")
    )
    return dialogs.strata_counts(rows, "stratum", "doc_id")


@query
def label_to_id(spark, folder):
    ids = tables.map_values(F.col("lang"), {"en": 0, "fr": 1, "de": 2}, default=1)
    return documents(spark, folder).select(
        "doc_id", ids.cast("long").alias("with_default"),
        tables.map_values(F.col("lang"), {"en": "english", "es": "spanish"}).alias("without_default"),
    )


@query
def label_by_table(spark, folder):
    """Every document's source ranked by its number of documents, through a lookup table made from the data."""
    sizes = documents(spark, folder).groupBy("source").agg(F.count("*").alias("source_size"))
    return tables.map_by_table(documents(spark, folder).select("doc_id", "source"), "source", sizes, "doc_id")


@query
def member_flags(spark, folder):
    """Turns of the conversations that have a system prompt."""
    rows = conversations(spark, folder)
    systems = rows.where(F.col("speaker") == "system").select("conv_no")
    return tables.flag_members(rows.select("conv_no", "turn"), "conv_no", systems, row_id="turn")


@query
def disagreements(spark, folder):
    def annotated(rule):
        label = F.struct(F.col(rule).alias("correct"), F.array(F.col("lang")).alias("error_type"))
        return rated(spark, folder).select(F.col("doc_id").alias("row_id"), label.alias("label"))

    differing = tables.disagreements(annotated("word"), annotated("substring"))
    return differing.select("row_id", F.col("label.correct").alias("correct"), F.size("label.error_type").cast("long").alias("errors"))


@query
def residual_rows(spark, folder):
    labels = table(spark, folder, "labels")
    good, toxic = labels.where(F.col("quality") == 1), labels.where(F.col("toxic") == 1)
    return tables.rows_not_in(documents(spark, folder).select("doc_id", "lang"), [good, toxic], "doc_id")


@query
def rows_except(spark, folder):
    docs = documents(spark, folder)
    return tables.rows_except(docs.select("lang", "source"), docs.where(F.col("lang") == "en").select("lang", "source"))


@query
def distinct_labels(spark, folder):
    return metrics.distinct_values((documents(spark, folder), "lang"), (conversations(spark, folder), "speaker"))


# positions ------------------------------------------------------------------------------------------------------------


@query
def row_numbers(spark, folder):
    docs = documents(spark, folder).select("doc_id", "n_chars")
    return positions.row_ids(docs, [F.desc("n_chars"), "doc_id"])


@query
def file_positions(spark, folder):
    return read_parquet(spark, f"{folder}/documents.parquet").select("row_id", "doc_id", "lang")


@query
def running_totals(spark, folder):
    docs = documents(spark, folder).select("doc_id", "lang", "n_chars")
    return positions.running(docs, "doc_id", {"chars": F.col("n_chars")}, {"longest": F.col("n_chars")}, by=["lang"])


@query
def slice_rows(spark, folder):
    docs = documents(spark, folder).select("doc_id", "lang")
    parts = [
        positions.take_slice(docs, 100, 250, "doc_id"), positions.head_share(docs, 0.15, "doc_id"),
        positions.last_row(docs, "doc_id"), positions.head_rows(docs, 22, "doc_id"),
    ]
    return positions.stack_parts(parts).withColumn("part", F.col("part").cast("long"))


@query
def concat_ranges(spark, folder):
    ranges = [(0, 75), (600, 675), (50, 60), (700, None)]
    return positions.concat_ranges(
        documents(spark, folder).select(F.col("doc_id").alias("row_id"), F.col("doc_id"), "lang"), ranges
    )


@query
def qc_batches(spark, folder):
    docs = documents(spark, folder).select("doc_id")
    return positions.qc_batches(docs, 60, 15, 105, 4, "doc_id")


@query
def qc_restore(spark, folder):
    docs = documents(spark, folder).select("doc_id", "lang")
    dealt = positions.qc_batches(docs, 60, 15, 105, 4, "doc_id").drop("doc_id")
    return positions.restore_batches(dealt, 60, 15, 105, 4, "doc_id").select("doc_id", "lang")


# conversations --------------------------------------------------------------------------------------------------------


@query
def dialogue_number(spark, folder):
    rows = marker_table(spark, folder)
    return dialogs.number_dialogues(rows, dialogs.is_marker(F.col("speaker"))).drop("text")


@query
def chunk_relabel(spark, folder):
    rows = marker_table(spark, folder)
    one = settle(dialogs.number_dialogues(rows, dialogs.is_marker(F.col("speaker"))).select("conv_no", "turn"))
    two = documents(spark, folder).select(F.col("doc_id").alias("conv_no"), F.lit(0).cast("long").alias("turn"))
    both = positions.chunk_dialogues(one, 7).withColumn("source", F.lit("E")).unionByName(
        positions.chunk_dialogues(two, 7).withColumn("source", F.lit("D"))
    )
    return positions.relabel_dialogues(both).select("source", "conv_no", "turn", "chunk", "new_conv_no")


@query
def rows_before_dialogue(spark, folder):
    rows = marker_table(spark, folder)
    numbered = dialogs.number_dialogues(rows, dialogs.is_marker(F.col("speaker")))
    return tables.before_dialogue(numbered, 22).select("row_id", "conv_no")


@query
def speaker_number(spark, folder):
    return dialogs.number_speakers(conversations(spark, folder)).select("conv_no", "turn", "speaker", "speaker_no")


@query
def utterance_rows(spark, folder):
    return dialogs.utterance_rows(nested(spark, folder), pack=lambda line: text.pack_paragraphs(line, 30, ". "))


@query
def utterance_rows_unpacked(spark, folder):
    return dialogs.utterance_rows(nested(spark, folder), markers=False, keep=["filename"])


@query
def rebuild_conversation(spark, folder):
    fields = {"speaker": F.col("speaker"), "utterance": F.col("text")}
    rebuilt = dialogs.rebuild_conversations(conversations(spark, folder), fields, part_rows=3)
    shown = F.transform("conversation", lambda item: F.concat(item["speaker"], F.lit(": "), item["utterance"]))
    return rebuilt.select("conv_no", "part", F.array_join(shown, "\n").alias("conversation"))


@query
def annotated_conversation(spark, folder):
    """The marker table put together again and joined to its source records."""
    numbered = dialogs.number_dialogues(marker_table(spark, folder), dialogs.is_marker(F.col("speaker")))
    turns = numbered.where(F.col("turn") > 0).withColumn("turn", F.col("turn") - 1)
    raters = names.annotations([F.col("speaker")] * 3, [F.lower("speaker")])
    rebuilt = dialogs.rebuild_conversations(
        turns, {"utterance": F.col("text"), "speaker": F.col("speaker"), "annotations": raters}, part_rows=10_000
    )
    joined = dialogs.annotated_records(rebuilt, first_turns(spark, folder))
    votes = F.flatten(F.transform("conversation", lambda item: item["annotations"]["emotion"]))
    return joined.select("conv_no", "part", "first_matches", F.size(votes).cast("long").alias("votes"))


@query
def annotated_turns(spark, folder):
    """The same records turn by turn, with all that they hold."""
    numbered = dialogs.number_dialogues(marker_table(spark, folder), dialogs.is_marker(F.col("speaker")))
    turns = numbered.where(F.col("turn") > 0).withColumn("turn", F.col("turn") - 1)
    raters = names.annotations([F.col("speaker")] * 3, [F.lower("speaker")])
    rebuilt = dialogs.rebuild_conversations(
        turns, {"utterance": F.col("text"), "speaker": F.col("speaker"), "annotations": raters}, part_rows=10_000
    )
    said = rebuilt.select("conv_no", "part", F.posexplode("conversation").alias("turn", "item"))
    return said.select(
        "conv_no", "part", F.col("turn").cast("long").alias("turn"), "item.speaker", digest(F.col("item.utterance")).alias("text"),
        F.array_join("item.annotations.emotion", ",").alias("emotion"), F.array_join("item.annotations.sentiment", ",").alias("sentiment"),
    )


@query
def split_annotated_rows(spark, folder):
    rows = conversations(spark, folder).withColumn("remarks", F.col("speaker"))
    return dialogs.split_annotated(rows, pack, keep=["conv_no", "turn"])


@query
def sampled_segments(spark, folder):
    """Conversation records flattened under quotas."""
    quotas = sampling.strata_quotas(300, {"C": 1, "D": 5})
    return sample_segments(nested(spark, folder), quotas, 2000, 30, ". ", {"C": 2, "D": 3}, 30, word="src1")


# samples --------------------------------------------------------------------------------------------------------------


@query
def quota_walk(spark, folder):
    docs = texts(spark, folder).select("doc_id", "lang", F.size(pack(F.col("text"))).cast("long").alias("size"))
    quotas = {"en": 200.5, "fr": 40.0, "de": 1000.0}
    return sampling.quota_sample(docs, "lang", "size", quotas, 2000, "doc_id", {"en": 5}, 12)


@query
def shuffle_rank(spark, folder):
    docs = documents(spark, folder).select("doc_id", "lang")
    whole = sampling.shuffled_positions(docs, 14, "doc_id")
    return sampling.shuffled_positions(whole, 10, "doc_id", ("lang",), "position_in_lang")


@query
def seeded_shuffle(spark, folder):
    return sampling.seeded_shuffle(documents(spark, folder).select("doc_id", "lang"), 14, "doc_id")


@query
def stratified_split(spark, folder):
    docs = documents(spark, folder).select("doc_id", "source")
    return sampling.stratified_split(docs, "source", 0.7, 88, "doc_id")


@query
def fixed_split(spark, folder):
    return sampling.fixed_split(documents(spark, folder).select("doc_id", "lang"), "lang", 5, 7, 42, "doc_id")


@query
def random_split(spark, folder):
    return sampling.random_split(documents(spark, folder).select("doc_id", "lang"), 0.15, 42, "doc_id")


@query
def bootstrap(spark, folder):
    return sampling.bootstrap(documents(spark, folder).select("doc_id", "lang"), "lang", 50, 10, "doc_id")


# scores ---------------------------------------------------------------------------------------------------------------


@query
def accuracy(spark, folder):
    return rounded(metrics.accuracy(rated(spark, folder), "lang", "word", ["source"]), "accuracy")


@query
def accuracy_by_label(spark, folder):
    """A label without rows has no accuracy, shown as -1."""
    return rounded(metrics.accuracy_by_label(rated(spark, folder), "lang", "word", [*LANGUAGES, "it"]), "accuracy").fillna(-1.0)


@query
def accuracy_by_seen_label(spark, folder):
    return rounded(metrics.accuracy_by_label(rated(spark, folder), "lang", "bare"), "accuracy")


@query
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(rated(spark, folder), "lang", "word", LANGUAGES)


@query
def classification_report(spark, folder):
    return rounded(
        metrics.classification_report(rated(spark, folder), "lang", "word", [*LANGUAGES, "it"]), "precision", "recall", "f1"
    )


@query
def classification_report_seen_labels(spark, folder):
    """Labels taken from the data; a missing prediction counts as English."""
    df = rated(spark, folder).fillna({"bare": "en"})
    return rounded(metrics.classification_report(df, "lang", "bare"), "precision", "recall", "f1").drop("ordinal")


@query
def report_all_runs(spark, folder):
    return rounded(all_reports(spark, folder), "precision", "recall", "f1")


@query
def leaderboard(spark, folder):
    return runs.leaderboard(all_reports(spark, folder))


@query
def top_runs(spark, folder):
    return runs.top_runs(runs.leaderboard(all_reports(spark, folder)), 2)


@query
def report_document(spark, folder):
    """Report documents, shown by their keys in written order and the lines of one field."""
    documents_ = writers.report_documents(all_reports(spark, folder))
    labels = F.regexp_extract_all("document", F.lit(r'\n  "([^"]+)": '), 1)
    supports = F.regexp_extract_all("document", F.lit(r'"support": ([0-9]+)'), 1)
    return documents_.select(
        *runs.RUN_KEYS, "target", F.array_join(labels, ",").alias("labels"), F.array_join(supports, ",").alias("supports")
    )


@query
def report_document_lines(spark, folder):
    """Whole report documents, read back line by line."""
    lines = readers.report_lines(writers.report_documents(all_reports(spark, folder)))
    return rounded(lines, "precision", "recall", "f1")


@query
def pending_runs(spark, folder):
    """Runs of a settings grid over all sources that no English document has finished."""
    grid = runs.param_grid(spark, {"lang": LANGUAGES, "combined": [True, False], "temperature": ["0.01", "0.1"]})
    docs = documents(spark, folder)
    sources = docs.select("source", "lang").distinct()
    wanted = runs.known_only(sources, F.broadcast(grid), "lang")
    finished = docs.where(F.col("lang") == "en").select("source", "lang", F.lit(True).alias("combined"))
    return runs.pending(wanted, finished, ["source", "lang", "combined"])


@query
def value_counts(spark, folder):
    return metrics.value_counts(rated(spark, folder), "word")


@query
def describe_length(spark, folder):
    described = metrics.describe(documents(spark, folder), "n_chars")
    return rounded(described, "mean", "std", "min", "p25", "p50", "p75", "max")


@query
def rating_table(spark, folder):
    return metrics.rating_table(rated(spark, folder), ["doc_id"], ["word", "whitespace", "substring"], LANGUAGES)


@query
def rating_counts(spark, folder):
    return metrics.rating_counts(rated(spark, folder), "doc_id", ["word", "whitespace", "substring"])


@query
def fleiss_kappa(spark, folder):
    df = rated(spark, folder)
    whole = metrics.fleiss_kappa(df, ["word", "whitespace", "substring"]).withColumn("source", F.lit("all"))
    return rounded(whole.unionByName(metrics.fleiss_kappa(df, ["word", "whitespace", "substring"], ["source"])), "kappa")


# predictions ----------------------------------------------------------------------------------------------------------


def stand_in():
    """A scorer factory in place of a model: answers follow the length of the prompt. Being a closure, it travels to
    the workers whole, as a caller's own factory should."""
    answers = ("Happiness. Positive!", "other, neutral", "none of them")

    def factory():
        return lambda asked: [answers[len(prompt) % 3] for prompt in asked]

    return factory


@query
def batch_score(spark, folder):
    asked = documents(spark, folder).select("doc_id", prompts.build_prompt(F.col("text"), "").alias("prompt"))
    return scoring.batch_score(asked, {"prompt": "raw"}, stand_in()).select("doc_id", "raw")


@query
def predict_combined(spark, folder):
    posts = texts(spark, folder).select("doc_id", "text")
    return predict_posts(posts, stand_in()).drop("text")


@query
def predict_separate(spark, folder):
    posts = texts(spark, folder).select("doc_id", "text")
    return predict_posts(posts, stand_in(), combined=False, shots=0, roles=True).drop("text")


@query
def merge_two_passes(spark, folder):
    df = rated(spark, folder)
    return scoring.merge_passes(
        df.select("doc_id", F.col("word").alias("emotion")), df.select("doc_id", F.col("substring").alias("sentiment")), "doc_id"
    )


@query
def attach_predictions(spark, folder):
    """Where both tables have a column, the input's stays."""
    said = rated(spark, folder).select("doc_id", "word", F.upper("lang").alias("lang"))
    return scoring.attach(documents(spark, folder).select("doc_id", "lang"), said, "doc_id")


# files ----------------------------------------------------------------------------------------------------------------


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def stored_posts(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", "text", "lang", "n_chars")


def held_back(df: DataFrame) -> DataFrame:
    """Texts as digests, so that the whole rows compare."""
    return df.withColumn("text", digest(F.col("text")))


@query
def csv_in_ranges(spark, folder):
    """Texts with line breaks and quotes through a CSV table, read by many tasks, each record with its place."""
    path = new_folder(spark)
    writers.write_csv(stored_posts(spark, folder), path, ["doc_id"])
    return held_back(readers.read_csv(spark, path, "doc_id long, text string, lang string, n_chars long", ranges=True))


@query
def csv_one_task(spark, folder):
    path = new_folder(spark)
    writers.write_csv(stored_posts(spark, folder), path, ["doc_id"])
    return held_back(readers.read_csv(spark, path, "doc_id long, text string, lang string, n_chars long"))


@query
def csv_headerless(spark, folder):
    path = new_folder(spark)
    writers.write_csv(stored_posts(spark, folder).select("lang", "text", "doc_id"), path, ["doc_id"], header=False)
    return held_back(readers.read_headerless(spark, path, ("sentiment", "text", "id"), ranges=True))


@query
def csv_records(spark, folder):
    """Every field as text, those without a value as empty texts."""
    path = new_folder(spark)
    rows = stored_posts(spark, folder).withColumn("lang", F.when(F.col("n_chars") % 3 > 0, F.col("lang")))
    writers.write_csv(rows, path, ["doc_id"])
    return held_back(readers.read_records(spark, path, ranges=True))


@query
def csv_indexed(spark, folder):
    """The row number as a first column without a name."""
    path = new_folder(spark)
    writers.write_indexed_csv(stored_posts(spark, folder), path, [F.desc("n_chars"), "doc_id"])
    return held_back(readers.read_csv(spark, path, "place long, doc_id long, text string, lang string, n_chars long"))


@query
def csv_splits(spark, folder):
    """A folder for each class, read back as the splits of a dataset."""
    path = new_folder(spark)
    posts = stored_posts(spark, folder)
    writers.write_split_csv(posts.withColumn("part", F.col("lang")), path, "part", ["doc_id"])
    read = readers.read_splits(spark, path, ("part=de", "part=en"), "doc_id long, text string, lang string, n_chars long", suffix="")
    return held_back(read)


@query
def jsonl_conversations(spark, folder):
    """Nested records as JSON lines, unfolded after they are read."""
    path = new_folder(spark)
    turns = conversations(spark, folder)
    records = turns.groupBy(F.col("conv_no").cast("string").alias("filename")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "speaker", F.col("text").alias("utterance")))).alias("_turns")
    )
    nested_ = records.select("filename", F.lit("0").alias("index"), F.transform("_turns", lambda t: F.struct(t["speaker"].alias("speaker"), t["utterance"].alias("utterance"))).alias("conversation"))
    writers.write_jsonl(nested_, path, ["filename"])
    read = readers.read_conversations(spark, path)
    said = read.select("row_id", "filename", F.posexplode("conversation").alias("turn", "said"))
    return said.select("row_id", "filename", F.col("turn").cast("long").alias("turn"), "said.speaker", digest(F.col("said.utterance")).alias("text"))


@query
def json_array(spark, folder):
    """One file that holds all documents as an array, put together from parts and read in ranges."""
    path = f"{new_folder(spark)}.json"
    writers.write_json_array(stored_posts(spark, folder), path, ["doc_id"])
    return held_back(readers.read_json_array(spark, path, "doc_id long, text string, lang string, n_chars long", ranges=True))


@query
def text_lines(spark, folder):
    path = new_folder(spark)
    documents(spark, folder).orderBy("doc_id").select("text").write.text(path)
    return readers.read_lines(spark, path).select("row_id", digest(F.col("value")).alias("line"))


@query
def appended_once(spark, folder):
    """Two overlapping appends to a table of versions, the second one twice."""
    path = new_folder(spark)
    posts = stored_posts(spark, folder)
    versions.append(posts.where("doc_id % 3 <> 0").withColumn("lang", F.lit("first")), path, ["doc_id"])
    for _ in range(2):
        versions.append(posts, path, ["doc_id"])
    return held_back(versions.read_versions(posts, path))


@query
def answer_log(spark, folder):
    """Answers published range by range; half of the rows are in the log before the others are asked."""
    asked = documents(spark, folder).select("doc_id", prompts.build_prompt(F.col("text"), "").alias("prompt"))
    log = new_folder(spark)
    scoring.score_with_log(asked.where("doc_id % 2 = 0"), log, {"prompt": "raw"}, stand_in(), "doc_id")
    return scoring.score_with_log(asked, log, {"prompt": "raw"}, stand_in(), "doc_id")


@query
def prediction_tables(spark, folder):
    """The raw and the label table of predictions, read back side by side."""
    path = new_folder(spark)
    posts = texts(spark, folder).select(F.col("doc_id").alias("row_id"), F.col("doc_id").cast("string").alias("id"), "text")
    writers.write_predictions(predict_posts(posts, stand_in()), f"{path}/raw", f"{path}/labels", ["id"])
    raw = readers.read_csv(spark, f"{path}/raw", f"id string, {fixed.RAW_COLUMN} string")
    said = readers.read_csv(spark, f"{path}/labels", f"id string, {fixed.SENTIMENT_COLUMN} string, {fixed.EMOTION_COLUMN} string")
    return scoring.attach(raw, said)


def uneven(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of which one run is short, one repeats rows with another answer, and one has rows that no gold row has."""
    said = predictions(spark, folder)
    run = F.col("model_id")
    kept = said.where((run != "whitespace") | (F.col("row_id") % 7 != 0))
    again = said.where((run == "bare") & (F.col("row_id") % 5 == 0)).withColumn("said", F.lit("de"))
    surplus = said.where((run == "substring") & (F.col("row_id") % 3 == 0)).withColumn("row_id", -F.col("row_id") - 1)
    return kept.unionByName(again).unionByName(surplus)


@query
def report_uneven_runs(spark, folder):
    targets = {"language": ("gold", "said", LANGUAGES)}
    reports = runs.evaluate_runs(uneven(spark, folder), gold(spark, folder), targets, repeated="least")
    return rounded(reports, "precision", "recall", "f1")


@query
def run_coverage(spark, folder):
    return runs.coverage(uneven(spark, folder), gold(spark, folder))


def told(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by source with a gold mood and that of two rules."""
    place = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    rows = rated(spark, folder).withColumn("row_id", place.cast("long"))
    mood = lambda c: F.element_at(F.create_map(*[F.lit(x) for pair in zip(LANGUAGES, fixed.SENTIMENTS + fixed.SENTIMENTS[:1]) for x in pair]), c)
    held = rows.select("source", "row_id", mood(F.col("lang")).alias("gold"), *[mood(F.col(rule)).alias(rule) for rule in ("word", "bare")])
    return settle(held)


def write_run(held: DataFrame, root: str, source: str, rule: str) -> None:
    said = held.where(F.col("source") == source).select("row_id", F.lit("x").alias("text"), F.col(rule).alias(fixed.SENTIMENT_COLUMN), F.lit("other").alias(fixed.EMOTION_COLUMN))
    writers.write_csv(said.orderBy("row_id").drop("row_id"), f"{root}/{source}/{rule}/all/predictions.csv")


def gold_moods(held: DataFrame) -> DataFrame:
    return held.select(F.col("source").alias("dataset"), "row_id", F.col("gold").alias("voted_sentiment"), F.lit("other").alias("voted_emotion"))


@query
def report_folder_tree(spark, folder):
    """Runs stored as CSV in folders, found, read, held against gold rows of their dataset and scored."""
    root, held = new_folder(spark), told(spark, folder)
    for source in sorted(r["source"] for r in held.select("source").distinct().collect()):
        for rule in ("word", "bare"):
            write_run(held, root, source, rule)
    return rounded(evaluate_tree(spark, root, gold_moods(held)).where("target = 'sentiment'"), "precision", "recall", "f1")


@query
def report_arriving_runs(spark, folder):
    """The same runs scored by a file stream as they arrive: one rule's runs before the other's, the last call finds nothing new."""
    root, out, held = new_folder(spark), new_folder(spark), told(spark, folder)
    sources = sorted(r["source"] for r in held.select("source").distinct().collect())
    for rule in ("word", "bare", None):
        for source in sources if rule else ():
            write_run(held, root, source, rule)
        arriving.score_available(spark, root, gold_moods(held), f"{out}/reports", f"{out}/stream")
    return rounded(arriving.latest_reports(spark, f"{out}/reports").where("target = 'sentiment'"), "precision", "recall", "f1")
