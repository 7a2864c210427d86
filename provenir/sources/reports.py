"""The stores of reports, answers and calibrations: versioned tables with what an application does to them."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import recalibrate
from ..operators.calibrate import MIN_ANSWERS
from ..operators.likelihood import DEFAULT
from .store import HISTORY, REPORT_ID
from .versioned import Table

SAMPLES = "sample_id long, sample_group long, ai boolean, weight long, tokens long, mean_log_prob double, mean_entropy double, criterion double, binoculars double"
ANSWERS = "report_id string, label string, vendor string, tokens long, mean_log_prob double, mean_entropy double, criterion double, binoculars double, domain string, model string, at timestamp"


class AnswerNotPossible(ValueError):
    """The report has no measure, or not a full one, for an answer to be about."""


class NotEnoughAnswers(ValueError):
    """A calibration needs MIN_ANSWERS usable answers."""


class Reports:
    """Reports by report_id, the newest `most` of them by `created`; columns are those of `schema`, these two included."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, most: int = HISTORY):
        self.table, self.most = Table(spark, path, schema), most

    def save(self, reports: DataFrame) -> None:
        """Reports take the place of those with the same id; what is beyond the newest goes."""
        self.table.upsert(reports, ["report_id"])
        self.table.retain(self.most, [F.desc("created"), F.desc("report_id")], ["report_id"])

    def find(self, report_id: str) -> DataFrame:
        """The report of this id; none for what is no id."""
        return self.table.read().where(F.col("report_id").rlike(REPORT_ID) & (F.col("report_id") == report_id))

    def history(self) -> DataFrame:
        return self.table.read().orderBy(F.desc("created"), F.desc("report_id")).limit(self.most)

    def delete(self, report_id: str) -> None:
        self.table.delete(F.col("report_id").rlike(REPORT_ID) & (F.col("report_id") == report_id))

    def clear(self) -> None:
        self.table.clear()


class Calibrations:
    """Base samples, answers to reports, the calibration in force, and the last proposal with what it was made of."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.samples, self.answers = Table(spark, f"{path}/samples", SAMPLES), Table(spark, f"{path}/answers", ANSWERS)
        self.saved = Table(spark, f"{path}/calibrations", "version int, calibration string, applied_at timestamp")
        self.proposals = Table(spark, f"{path}/proposals", "key string, proposal string")

    def set_answer(self, reports: Reports, report_id: str, label: str | None, vendor: str | None = None, at: datetime.datetime | None = None) -> dict | None:
        """Answer whether the report's text is an assistant's ("ai") or not ("human"); None takes the answer back.

        The report must have model_status, model_domain, tokens, model and the measures.
        """
        if label is None:
            self.answers.delete(F.col("report_id") == report_id)
            return None
        r = reports.find(report_id).first()
        if r is None or r.model_status != "used" or r.mean_log_prob is None or not r.tokens:
            raise AnswerNotPossible("cette analyse n'a pas de mesure du modèle de langage")
        if r.mean_entropy is None or r.criterion is None:
            raise AnswerNotPossible("analyse faite avant la mise à jour de la mesure : relancez-la pour pouvoir répondre")
        row = {"report_id": report_id, "label": label, "vendor": vendor if label == "ai" else None} | {c: r[c] for c in ("tokens", "mean_log_prob", "mean_entropy", "criterion", "binoculars")}
        row |= {"domain": r.model_domain or "prose", "model": r.model, "at": at or datetime.datetime.now()}
        self.answers.upsert(self.spark.createDataFrame([tuple(row.values())], ANSWERS), ["report_id"])
        return row

    def answer(self, report_id: str) -> dict | None:
        r = self.answers.read().where(F.col("report_id") == report_id).first()
        return r.asDict() if r else None

    def active(self) -> dict:
        """The calibration that was applied last, of the version that is understood; the default after a reset."""
        r = self.saved.read().where("version = 3").orderBy(F.desc("applied_at")).first()
        return _thawed(json.loads(r.calibration)) | {"applied_at": r.applied_at} if r else DEFAULT

    def _numbered(self) -> DataFrame:
        """Answers with answer_id from 0 by time: each is a group of samples of its own."""
        from ..operators.ordered import running

        x = running(self.answers.read(), [], ["at", "report_id"], rank="answer_id")
        return x.withColumn("answer_id", F.col("answer_id") - 1)

    def propose(self, model: str | None) -> dict | None:
        return recalibrate.propose(self.samples.read(), self._numbered(), self.active(), model)

    def apply(self, model: str | None, at: datetime.datetime | None = None) -> dict:
        """Make the proposal of all answers the calibration in force."""
        p = self.propose(model)
        if p is None:
            raise NotEnoughAnswers(f"il faut au moins {MIN_ANSWERS} réponses sur de la prose")
        at = at or datetime.datetime.now()
        row = [(3, json.dumps(p["calibration"]), at)]
        self.saved.replace(self.spark.createDataFrame(row, "version int, calibration string, applied_at timestamp"))
        return self.active()

    def reset(self) -> dict:
        """Back to the default; earlier calibrations stay readable as versions of the table."""
        self.saved.clear()
        return self.active()

    def key(self, model: str | None) -> str:
        """What a proposal depends on, in one value: samples, answers, calibration and model."""
        applied = self.active()["applied_at"]
        of_answers = recalibrate.status_key(self.answers.read().withColumnRenamed("report_id", "answer_id"), model, F.lit(applied)).first()[0]
        return f"{self.samples.version()}|{of_answers}"

    def status(self, model: str | None) -> dict:
        """The calibration in force, answers by label and assistant, how many are needed, and what a new one would change.

        The proposal is made where the last one was made of something else, and kept.
        """
        key = self.key(model)
        held = self.proposals.read().where(F.col("key") == key).first()
        if held is None:
            text = json.dumps(self.propose(model), default=str)
            self.proposals.replace(self.spark.createDataFrame([(key, text)], "key string, proposal string"))
        else:
            text = held.proposal
        told = recalibrate.answers_summary(self.answers.read(), model).collect()  # a row for each label and assistant
        counts = {r.name: r.n for r in told if r.kind == "label"}
        answers = {k: counts.get(k, 0) for k in ("ai", "human", "unused")} | {"vendors": {r.name: r.n for r in told if r.kind == "vendor"}}
        proposal = json.loads(text)
        return {"active": self.active(), "answers": answers, "minimum": MIN_ANSWERS, "proposal": proposal and proposal | {"calibration": _thawed(proposal["calibration"])}}


def _thawed(calibration: dict) -> dict:
    """A calibration as it was before it became JSON, with tuples."""
    formula = lambda f: f and f | {"features": {k: tuple(v) for k, v in f["features"].items()}, "thresholds": tuple(map(tuple, f["thresholds"])), "rates": tuple(map(tuple, f["rates"]))}
    return calibration | {"measures": formula(calibration["measures"]), "binoculars": formula(calibration["binoculars"]), "rates": tuple(map(tuple, calibration["rates"]))}
