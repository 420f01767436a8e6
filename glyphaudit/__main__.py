"""Command line: ``python -m glyphaudit scan <pages or nodes> | campaign <targets> | page <results> | metrics <results> | rules``.

Exit codes: 0 nothing found, 1 findings, 2 it failed or no site was scanned, 3 wrong usage or an unusable target list.

A campaign reads what was captured before, Parquet tables in one folder: ``robots`` (url,
http_status, body, error), ``pages``, ``nodes`` and ``standard`` as in ``schema``; ``pages`` may have ``passes``.
It writes a folder ``campaign-<day>``, from whose newest ``page`` and ``metrics`` make a page and a block of a README.
"""

from __future__ import annotations

import argparse
import sys

from glyphaudit import report
from glyphaudit.dims import LABELS, OUTCOMES, SEVERITIES

FORMATS = ("text", "json", "html")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphaudit")
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="check captured nodes, or the HTML of pages")
    scan.add_argument("path")
    scan.add_argument("--html", action="store_true", help="the table holds page_id and html")
    scan.add_argument("--pages", help="table of the scans' pages, as in schema")
    scan.add_argument("--standard", help="third-party findings, one JSON object a line")
    scan.add_argument("--rules", nargs="*")
    scan.add_argument("--disable", nargs="*")
    scan.add_argument("--scripts", nargs="*", choices=[s for s in LABELS if s not in OUTCOMES])
    scan.add_argument("--severity", choices=SEVERITIES)
    scan.add_argument("--format", choices=FORMATS, default="text", help="of the reports")
    scan.add_argument("--out", help="folder for the findings, as Parquet, and a report for each page; needed for more than one page")
    run = sub.add_parser("campaign", help="records and aggregate of the sites on a target list")
    run.add_argument("targets")
    run.add_argument("--captured", required=True, help="folder of captured tables")
    run.add_argument("--out", required=True, help="folder for the campaign's document")
    run.add_argument("--limit", type=int, help="only the first targets of the list")
    run.add_argument("--html", action="store_true", help="write the campaign's page as well")
    run.add_argument("--day", help="of the document's name; today if not given")
    page = sub.add_parser("page", help="the page of the newest stored campaign")
    page.add_argument("results")
    page.add_argument("out")
    metrics = sub.add_parser("metrics", help="put the newest stored campaign's numbers between a README's markers")
    metrics.add_argument("results")
    metrics.add_argument("readme")
    sub.add_parser("rules", help="list the checks")
    return p


def stored_campaign(spark, folder: str) -> tuple[dict, list[dict]]:
    """The manifest of a stored campaign, one row, and the first sites that aren't in their group's script."""
    from glyphaudit.operators import documents

    held, _, mismatches = documents.read(spark, folder)
    return held.first().asDict(recursive=True), [r.asDict() for r in mismatches.orderBy("list_ord").limit(report.NAMED).collect()]


def campaign_command(a: argparse.Namespace) -> int:
    from datetime import date

    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from glyphaudit.functions.scripts import analysed
    from glyphaudit.operators import campaign, documents, engine, pages, records, robots
    from glyphaudit.session import session
    from glyphaudit.sources import files

    spark = session()
    try:
        listed = files.targets(spark, a.targets)
        problems = campaign.target_errors(listed).limit(100).collect()
    except PySparkException as e:
        print(e, file=sys.stderr)
        return 3
    if problems:
        for r in problems:
            print(f"target {r['list_ord'] + 1}: {r['problem']}", file=sys.stderr)
        return 3
    if a.limit is not None and a.limit < 1:
        print("--limit must be 1 or more", file=sys.stderr)
        return 3
    chosen = listed.where(F.col("list_ord") < a.limit) if a.limit is not None else listed
    folder = f"{a.out}/campaign-{a.day or date.today().isoformat()}"
    try:
        read = lambda name: spark.read.parquet(f"{a.captured}/{name}")
        scans = read("pages")
        if "passes" not in scans.columns:
            scans = scans.withColumn("passes", F.lit(0).cast("long"))
        nodes, fetched = analysed(read("nodes")).persist(), read("robots")
        sites = records.site_records(chosen, robots.decisions(fetched), fetched, scans, read("standard"), engine.findings(nodes), pages.script_tally(nodes), pages.unsupported(nodes))
        documents.write(sites, documents.Run(a.targets, listed.count()), folder)
        nodes.unpersist()
        stored, mismatches = stored_campaign(spark, folder)
        if a.html:
            files.write_text(spark, f"{a.out}/index.html", report.campaign_html(stored, mismatches))
    except Exception as e:
        print(e, file=sys.stderr)
        return 2
    totals = stored["aggregate"]
    outcomes = {o["status"]: o["n_sites"] for o in totals["outcomes"]}
    found = {x["layer"]: x["n_elements"] for x in totals["layers"]}
    print(" · ".join(f"{n} {s}" for s, n in outcomes.items()), file=sys.stderr)
    print(f"third-party checks reported {found['standard']}, ours {found['script_aware']}; percentages are of {totals['percentages_are_out_of']} scanned", file=sys.stderr)
    return 2 if not outcomes["scanned"] else int(sum(found.values()) > 0)


def stored_command(a: argparse.Namespace) -> int:
    """Renders the newest stored campaign: its page, or the block of a README."""
    from glyphaudit.session import session
    from glyphaudit.sources import files

    spark = session()
    try:
        folder = files.newest(spark, a.results)
        stored, mismatches = stored_campaign(spark, folder)
        if a.command == "page":
            files.write_text(spark, f"{a.out}/index.html", report.campaign_html(stored, mismatches))
        else:
            files.write_text(spark, a.readme, report.splice(files.read_text(spark, a.readme), report.metrics_block(stored)))
    except Exception as e:
        print(e, file=sys.stderr)
        return 2
    print(folder, file=sys.stderr)
    return 0


def scan_command(a: argparse.Namespace) -> int:
    """Analyses the nodes once; what was shown, withheld or couldn't be judged is counted while findings are written."""
    from pyspark.sql import functions as F

    from glyphaudit.functions.scripts import analysed
    from glyphaudit.operators import engine, page_reports, pages
    from glyphaudit.session import session
    from glyphaudit.sources import files, html

    spark = session()
    strangers = engine.unrecognised(spark, [*(a.rules or []), *(a.disable or [])])
    filters = engine.Filters(*(tuple(x) if x is not None else None for x in (a.rules, a.disable, a.scripts)), a.severity)
    checked = found = None
    try:
        nodes = html.as_snapshot(html.text_nodes(spark.read.parquet(a.path))) if a.html else files.snapshots(spark, a.path)
        checked = analysed(nodes).persist()
        if not a.out and checked.select("page_id").distinct().limit(2).count() > 1:
            raise ValueError("more than one page: name a folder with --out")
        found = engine.findings(checked).persist()
        marked, counts = engine.counted(found, filters)
        if a.out:
            files.save(marked.where("kept").drop("kept"), f"{a.out}/findings")
        else:
            marked.write.format("noop").mode("overwrite").save()
        scans = files.pages(spark, a.pages) if a.pages else page_reports.bare_scans(checked)
        standard = files.third_party(spark, a.standard) if a.standard else files.no_third_party(spark)
        reports = page_reports.page_reports(scans, standard, found, pages.script_tally(checked), pages.unsupported(checked), filters)
        shown = page_reports.rendered(reports, a.format)
        if a.out:
            files.save(shown, f"{a.out}/reports", "json")
        else:
            for r in shown.collect():  # one page
                print(r["report"])
        strange = pages.unsupported(checked).agg(F.sum("n_nodes").alias("n_nodes"), F.min_by("samples", "page_id").alias("samples")).first()  # one row
        for line in report.notices(strangers, strange.asDict() if strange["n_nodes"] else None, (0, counts.get["withheld"])):
            print(line, file=sys.stderr)
        return 1 if counts.get["shown"] else 0
    except Exception as e:
        print(e, file=sys.stderr)
        return 2
    finally:
        for table in (checked, found):
            if table is not None:
                table.unpersist()


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 3 if e.code else 0
    if a.command == "rules":
        print(report.rules_text())
        return 0
    return {"campaign": campaign_command, "scan": scan_command}.get(a.command, stored_command)(a)


if __name__ == "__main__":
    sys.exit(main())
