"""A dozen documents and one question for each: enough to try an embedder end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAIRS = (
    ("Bread rises because yeast turns sugar into gas that the dough holds.", "why does dough get bigger"),
    ("A tide gauge records how high the sea stands at a harbour wall.", "instrument for measuring sea level"),
    ("Beavers fell trees and dam streams to make ponds around their lodges.", "animals that build dams"),
    ("The violin's bridge carries the vibration of the strings to the body.", "how do strings make a violin sound"),
    ("Concrete hardens by a reaction of cement with water, not by drying.", "what makes cement set"),
    ("Bats find insects in the dark by the echo of their own calls.", "hunting with sound at night"),
    ("A sundial shows the hour by the shadow of a slanted rod.", "telling time without a clock"),
    ("Saffron is picked by hand from the flowers of a crocus.", "most expensive spice origin"),
    ("Locks lift boats from one level of a canal to the next.", "how do ships climb hills"),
    ("The spleen filters old cells from the blood.", "organ that removes worn out blood cells"),
    ("Glass is drawn into fibres that carry light over long distances.", "cables made of light"),
    ("Terraces keep rain from washing the soil off steep fields.", "farming on slopes"),
)


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"d{i}", d) for i, (d, _) in enumerate(PAIRS)], "_id string, text string")


def questions(spark: SparkSession) -> DataFrame:
    """(_id, text, corpus_id): corpus_id is the one right document."""
    return spark.createDataFrame([(f"q{i}", q, f"d{i}") for i, (_, q) in enumerate(PAIRS)], "_id string, text string, corpus_id string")
