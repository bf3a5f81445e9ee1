"""Sections of descriptions on hand-worked texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from harvestry.operators.sections import is_heading, lines_of, sections

CASES = {
    "We bake.\n\nResponsibilities:\n• Knead • Shape\n\nREQUIRED SKILLS -\nan oven": [("description-0", "Description", "We bake."), ("responsibilities-1", "Responsibilities", "•  Knead\n•  Shape"), ("required-skills-2", "REQUIRED SKILLS", "an oven")],
    "Benefits\n\nSkills\nflour": [("skills-1", "Skills", "flour")],
    "Join us. Minimum qualifications: Two arms.": [("description-0", "Description", "Join us."), ("minimum-qualifications-1", "Minimum qualifications", "Two arms.")],
    "  ": [],
    "Qualifications": [("description-0", "Description", "Qualifications")],
    "x" * 600: [("description-0", "Description", "x" * 600)],
    " ".join(f"Sentence {i:03d} is of no great length at all." for i in range(15)): [("description-0", "Description", "\n\n".join(" ".join(f"Sentence {i:03d} is of no great length at all." for i in part) for part in (range(7), range(7, 14), range(14, 15))))],
}


@pytest.mark.parametrize("text", CASES)
def test_sections(spark, text):
    got = sections(spark.createDataFrame([(1, text), (2, None)], "id long, text string")).orderBy("position").collect()
    assert [(r.slug, r.title, r.body) for r in got] == CASES[text]


@pytest.mark.parametrize(("line", "want"), [("About the Role", True), ("• Skills", False), ("What you’ll do:", True), ("Team Benefit Overview", True), ("Team Lunch", False), ("WHO WE ARE", True), ("WE ARE GREAT!", False), ("Preferred qualifications, if any", True), ("no", False), ("We offer benefit and more of it", False)])
def test_headings(spark, line, want):
    assert spark.range(1).select(is_heading(F.lit(line)).alias("h")).first().h is want


def test_lines(spark):
    got = spark.range(1).select(lines_of(F.lit("• one\n\n- two\nthree")).alias("x")).first().x
    assert [(r.type, r.text) for r in got] == [("bullet", "one"), ("bullet", "two"), ("text", "three")]
