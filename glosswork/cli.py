"""A console: translate lines, import the datasets found, or quit.  Ends at end of input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from glosswork.operators.store import PhraseStore, Translator
from glosswork.sources.moses import datasets_path, scan


def ask(prompt: str) -> str | None:
    print(prompt, end="", flush=True)
    line = sys.stdin.readline()
    return line.rstrip("\n") if line else None


def translate_menu(store: PhraseStore, debug: bool) -> None:
    source, target = ask("source language [en]: "), ask("target language [pt_BR]: ")
    source, target = source or "en", target or "pt_BR"
    if not store.has_pair(source, target):
        print("no translations for this pair")
        return
    translator = Translator(store.lookup())
    while (line := ask("> ")) not in (None, ""):
        print(translator.translate_text(line, source, target))
        if debug:
            print(*translator.last_trace(), translator.statistics, sep="\n")


def import_menu(store: PhraseStore, directory: str) -> None:
    found = scan(store.spark, directory).collect()
    for i, d in enumerate(found, 1):
        print(f"{i}. {d['corpus_name']} {d['source_language']}-{d['target_language']}")
    choice = ask("number: ")
    if choice and choice.isdigit() and 1 <= int(choice) <= len(found):
        d = found[int(choice) - 1]
        print(store.import_both(d["source_file"], d["target_file"], d["source_language"], d["target_language"]), store.cleanup_stats)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="glosswork")
    parser.add_argument("--store", default="phrases")
    parser.add_argument("--datasets", default=None)
    parser.add_argument("--debug", action="store_true")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("glosswork").getOrCreate()
    store = PhraseStore(spark, given.store).initialize()
    print(*store.report(), sep="\n")
    while (choice := ask("1 translate, 2 import, 0 quit: ")) not in (None, "0"):
        if choice == "1":
            translate_menu(store, given.debug)
        elif choice == "2":
            import_menu(store, given.datasets or datasets_path())
    return 0


if __name__ == "__main__":
    sys.exit(main())
