"""Templates, slot values and hand-written questions for the intent classifier, in wording of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import EXAMPLE, append_manual, augment, fill

TEMPLATES = {
    "advice": (
        "How do I get better at {skill}?",
        "What is a sensible way to {goal}?",
        "Should a {role} learn {skill}?",
        "Any tips for someone who wants to {goal}?",
        "Is {option_a} or {option_b} the better choice for a {role}?",
        "How would you deal with {trouble}?",
        "What should I know before I {goal}?",
        "Can you recommend something against {trouble}?",
        "I am a {role} and want to {goal}, where do I start?",
        "What mistakes should I avoid with {skill}?",
        "Which {option_a} is good for beginners?",
        "How much time does it take to {goal}?",
    ),
    "history": (
        "What led to {event}?",
        "How did {event} change {place}?",
        "What was life like in {place} during {era}?",
        "Who took part in {event}?",
        "How did {era} begin?",
        "Why did {era} come to an end?",
        "Tell me the story of {event}",
        "What were the consequences of {event}?",
        "How was {place} ruled in {era}?",
        "What do we know about {person} and {event}?",
        "Which events came before {event}?",
        "How did {person} rise to power?",
    ),
    "science": (
        "How does {process} work?",
        "Why does {phenomenon} happen?",
        "What causes {phenomenon}?",
        "Explain the mechanism behind {process}",
        "What is the difference between {concept_a} and {concept_b}?",
        "How do scientists measure {quantity}?",
        "What happens to {material} under high {quantity}?",
        "Why is {material} a good conductor?",
        "How are {concept_a} and {concept_b} related?",
        "What role does {material} play in {process}?",
        "Can {phenomenon} be explained by {concept_a}?",
        "What determines the {quantity} of a {material}?",
    ),
    "fact": (
        "What is the capital of {place}?",
        "How many people live in {place}?",
        "When was {person} born?",
        "Who wrote {work}?",
        "Where is {place}?",
        "What language is spoken in {place}?",
        "How tall is {landmark}?",
        "In which year did {event} take place?",
        "Who designed {landmark}?",
        "What is the currency of {place}?",
        "How long is {work}?",
        "What is {person} known for?",
    ),
    "verify": (
        "Is it true that {claim}?",
        "Is it a myth that {claim}?",
        "Does {habit} really cause {illness}?",
        "Can {habit} cure {illness}?",
        "Did {person} really say that {claim}?",
        "I heard that {claim}, is that right?",
        "Is there evidence that {claim}?",
        "Has it been debunked that {claim}?",
        "Do experts agree that {claim}?",
        "Is {habit} actually bad for you?",
        "Fact check: {claim}",
        "Are people wrong when they say {claim}?",
    ),
}
VALUES = {
    "skill": ("public speaking", "cooking", "programming", "drawing", "negotiation"),
    "goal": ("save money", "learn a language", "change jobs", "sleep better", "run a marathon"),
    "role": ("student", "nurse", "parent", "freelancer", "teacher"),
    "option": ("renting", "a used car", "night school", "a small laptop"),
    "trouble": ("stress at work", "noisy neighbours", "debt", "writer's block"),
    "event": ("the fall of Constantinople", "the French Revolution", "the Black Death", "the moon landing", "the Suez crisis"),
    "place": ("Portugal", "Japan", "Peru", "Egypt", "Norway", "Kenya"),
    "era": ("the Bronze Age", "the Renaissance", "the Cold War", "the Gilded Age"),
    "person": ("Cleopatra", "Simon Bolivar", "Marie Curie", "Genghis Khan", "Ada Lovelace"),
    "process": ("photosynthesis", "fermentation", "nuclear fusion", "vaccination", "erosion"),
    "phenomenon": ("lightning", "a solar eclipse", "magnetism", "the tide", "static electricity"),
    "concept": ("mass", "energy", "entropy", "gravity", "momentum"),
    "quantity": ("temperature", "pressure", "density", "voltage"),
    "material": ("copper", "water", "carbon", "glass"),
    "work": ("Don Quixote", "the Odyssey", "Moby Dick", "War and Peace"),
    "landmark": ("the Eiffel Tower", "the Golden Gate Bridge", "Big Ben", "the Colosseum"),
    "claim": ("we only use a tenth of our brain", "goldfish forget everything in seconds", "sugar makes children hyperactive", "the wall is visible from space", "cracking knuckles harms joints"),
    "habit": ("drinking coffee", "reading in the dark", "eating late", "vitamin C", "cold showers"),
    "illness": ("a cold", "arthritis", "insomnia", "headaches"),
}
#: Questions of which another mode's wording is close.
HARD = (
    ("Which language should I learn first?", "advice"),
    ("What is Rust used for?", "fact"),
    ("When was the republic founded?", "fact"),
    ("How was the republic founded?", "history"),
    ("Does garlic cure a cold?", "verify"),
    ("How does garlic act on bacteria?", "science"),
    ("Is a tomato a fruit?", "verify"),
    ("What family does the tomato belong to?", "fact"),
    ("hey what even is a black hole", "science"),
    ("wait is it true that bats are blind", "verify"),
    ("help me understand mortgages", "advice"),
    ("did nero really fiddle while rome burned", "verify"),
    ("tell me about the fire of rome", "history"),
    ("what happened in the fire of rome", "history"),
)


def templates(spark: SparkSession) -> DataFrame:
    """template_id, label, template."""
    rows = [(label, t) for label, ts in TEMPLATES.items() for t in ts]
    return spark.createDataFrame([(i, label, t) for i, (label, t) in enumerate(rows)], "template_id int, label string, template string")


def full(spark: SparkSession, copies: int = 15, ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """All examples (``EXAMPLE``): filled templates, noisy copies of a share of them, hand-written ones."""
    filled = fill(templates(spark), {k: list(v) for k, v in VALUES.items()}, copies, seed)
    keyed = filled.withColumn("key", F.col("template_id") * copies + F.col("copy"))
    return append_manual(augment(keyed, "key", ratio, seed), list(HARD))


def keyed(examples: DataFrame) -> DataFrame:
    """``examples`` with ``key``, a hash of their columns, for splits."""
    return examples.withColumn("key", F.md5(F.to_json(F.struct(*[c.split()[0] for c in EXAMPLE.split(", ")]))))
