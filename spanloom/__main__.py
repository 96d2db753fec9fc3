"""python -m spanloom TEXTS WORDS OUT: the build from files to files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import config
from .plans.build import build
from .sources import readers, writers


def parse(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="spanloom", description=__doc__)
    parser.add_argument("texts", help="folder or pattern of text files, a document each")
    parser.add_argument("words", help="folder or pattern of word files of the same names")
    parser.add_argument("out")
    parser.add_argument("--recordings", help="folder or pattern of WAV files of the same names")
    parser.add_argument("--overrides", help="JSON lines of spans set by hand")
    parser.add_argument("--files", action="store_true", help="manifests and reports as a file a document too")
    parser.add_argument("-c", "--config", help="YAML file")
    parser.add_argument("--tempo", type=float)
    parser.add_argument("--repeats", type=int, help="has no effect while dynamic repetitions are on")
    parser.add_argument("--pause", type=int, dest="pause_ms")
    parser.add_argument("--method", help="instead of the configured one; external needs a provider and is for the library, hybrid is fuzzy alone without one")
    return parser.parse_args(arguments)


def run(spark: SparkSession, options: argparse.Namespace) -> None:
    changes = {k: v for k in ("tempo", "repeats", "pause_ms") if (v := getattr(options, k)) is not None}
    own = config.load(options.config, **changes)
    if options.method:
        own = config.merge(own, {"alignment": {"method": options.method}})
    recordings = readers.read_recordings(spark, options.recordings) if options.recordings else None
    overrides = readers.read_overrides(spark, options.overrides) if options.overrides else None
    made = build(readers.read_texts(spark, options.texts), readers.read_words(spark, options.words), own, overrides=overrides, recordings=recordings)
    writers.write_manifests(made.manifests, made.reports, options.out)
    if options.files:
        writers.write_documents(made.manifests, "manifest", f"{options.out}/manifest_files")
        writers.write_documents(made.reports, "report", f"{options.out}/report_files")
    writers.write_summaries(made.summaries, f"{options.out}/summaries")
    if made.sounds is not None:
        writers.write_sounds(made.sounds, f"{options.out}/sounds")


if __name__ == "__main__":
    run(SparkSession.builder.appName("spanloom").getOrCreate(), parse())
