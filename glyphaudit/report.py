"""Reports as text, Markdown and HTML, from a page's report document or a campaign's manifest, never from nodes."""

from __future__ import annotations

import html
import textwrap

from glyphaudit.dims import SEVERITIES
from glyphaudit.operators.rules import RULES

BEGIN, END = "<!-- metrics:begin -->", "<!-- metrics:end -->"


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"


def rules_text() -> str:
    wide = max(len(r.id) for r in RULES)
    return "\n".join(f"{r.id:<{wide}}  {r.severity:<9} {r.confidence:<10} {r.title}" for r in RULES)


def caveats_text(row: dict) -> list[tuple[str, str]]:
    """Headings and bodies of what stands beside a campaign's numbers, from ``campaign.caveats``."""
    out = []
    if row["flagship_elements"] is not None:
        out.append(("Spaced joined letters", f"{plural(row['flagship_elements'], 'text')} on {plural(row['flagship_sites'], 'site')} had letter spacing on joined letters. However few there are, a reader of one of them can't read it."))
    if row["top_two"] is not None:
        names = " and ".join(f"{row[k + '_rule']} ({row[k + '_confidence'] or 'unrated'})" for k in ("first", "second"))
        out.append(("How sure the findings are", f"{names} were met on the most sites and make up {row['top_two_percent']}% of our findings ({row['top_two']} of {row['total']}). High confidence stands behind {row['high_confidence']}; the others need someone to look."))
    out.append(("Two units", "An element of a third-party check may hold many of the texts that our checks judge one by one. Compare sites within a layer, not the layers."))
    return out


def _markdown(rows: list[dict], columns: dict[str, str]) -> str:
    cell = lambda v: "–" if v is None else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns.values()) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)])


def metrics_block(stored: dict) -> str:
    """Markdown of a stored campaign's manifest, between the two markers: outcomes, layers, checks, scripts, groups, caveats."""
    a, listed = stored["aggregate"], stored["target_list"]
    measured, by = a["measured"], lambda kind: [m for m in a["measures"] if m["by"] == kind]
    counted = {"name": "", "n_sites": "Sites", "n_elements": "Texts", "n_certain": "Of high confidence"}
    left = f" {plural(stored['abandoned_scans'], 'scan')} ran out of time." if stored["abandoned_scans"] else ""
    parts = [
        f"Campaign of {day_of(stored['started_at']) or 'an unknown day'}: {listed['attempted']} of {listed['available']} listed sites were tried, {measured['n_scanned']} scanned, {measured['n_measured']} of them in a script of their group.{left} Percentages are of the scanned sites.",
        _markdown(a["outcomes"], {"status": "Outcome", "n_sites": "Sites"}),
        "### Layers",
        _markdown(a["layers"], {"layer": "Layer", "n_rules": "Checks with findings", "n_elements": "Found", "n_sites": "Sites with findings", "n_passes": "Passed"}),
        "### Script-aware checks",
        _markdown(a["issues_script_aware"], {"rule_id": "Check", "n_sites": "Sites", "percent_of_sites": "% of sites", "n_elements": "Texts", "severity": "Severity", "confidence": "Confidence"}),
        "### By writing system",
        _markdown(by("script"), counted | {"name": "Script"}),
        "### By group",
        _markdown(by("target_group"), counted | {"name": "Group"}),
        "### Read with care",
        *(f"**{h}.** {b}" for h, b in caveats_text(a["caveats"])),
    ]
    return "\n\n".join([BEGIN, *parts, END])


def day_of(at: str | None) -> str | None:
    return at[:10] if at else None


#: Findings of a check that a text report shows; the rest is counted.
SHOWN = 5


def page_report_text(model: dict, width: int = 92) -> str:
    """A page's report as text: both layers apart, then scripts, what could not be judged and what filters withheld."""
    s, a = model["summary"]["standard"], model["summary"]["scriptAware"]
    out = [model.get("url") or "", "", f"Third-party checks: {plural(s['rules'], 'rule')}, {plural(s['elements'], 'element')}, {s['passes']} passed"]
    out += [f"  {(g.get('impact') or 'ungraded').upper()}  {g.get('id')}  {g.get('help') or ''}  ({plural(len(g.get('nodes') or []), 'element')})" for g in model["standard"]["findings"]]
    out += ["", f"Script-aware checks: {plural(a['rules'], 'rule')}, {plural(a['elements'], 'element')}"]
    for g in model["scriptAware"]["rules"]:
        own = [f for f in model["scriptAware"]["findings"] if f["ruleId"] == g["ruleId"]]
        out.append(f"  {g['severity'].upper()}  {g['ruleId']}  {g['title']}  ({plural(g['elements'], 'element')}; {', '.join(g['scripts'])}; {g['confidence']})")
        out += textwrap.wrap(g["limitations"], width, initial_indent="    ", subsequent_indent="    ")
        for f in own[:SHOWN]:
            out += textwrap.wrap(f"{f.get('selector')}: {f['whatIsWrong']} {f['howToFix']}", width, initial_indent="    ", subsequent_indent="      ")
        if len(own) > SHOWN:
            out.append(f"    and {len(own) - SHOWN} more")
    if not a["elements"]:
        out.append("  No findings in what was checked.")
    if any(g["confidence"] == "heuristic" for g in model["scriptAware"]["rules"]):
        out.append("  Heuristic findings are inferences and can be wrong.")
    out += ["", "Scripts: " + ", ".join(f"{x['label']} {x['count']}" for x in model["summary"]["scriptsDetected"])]
    out += _beside(model)
    return "\n".join([*out, "", model["disclaimer"]])


def _beside(model: dict) -> list[str]:
    """What couldn't be judged, what filters withheld, and why a page couldn't be scanned."""
    out, strange, filters, error = [], model.get("unsupportedScript"), model.get("filters"), model.get("error")
    if strange:
        out.append(f"{plural(strange['nodeCount'], 'text node')} in no supported script weren't checked: " + " | ".join(strange["samples"]))
    if filters and sum(filters["withheld"].values()):
        out.append(f"Filters withheld {plural(filters['withheld']['standard'], 'third-party finding')} and {filters['withheld']['scriptAware']} of ours.")
    if error:
        out.append(error["message"])
    return out


#: Sites in another script than their group's that a campaign's page names; the rest is counted.
NAMED = 200


def campaign_html(stored: dict, mismatches: list[dict], title: str = "Campaign") -> str:
    """A stored campaign's page: the run, outcomes, both layers' issues apart, groups, sites that aren't in their group's script, caveats."""

    def table(rows: list[dict], columns: dict[str, str]) -> str:
        head = "".join(f"<th>{html.escape(name)}</th>" for name in columns.values())
        body = "".join("<tr>" + "".join(f"<td>{html.escape(', '.join(r[c]) if isinstance(r[c], list) else str(r[c]))}</td>" for c in columns) + "</tr>" for r in rows)
        return f"<table><tr>{head}</tr>{body}</table>"

    aggregate, listed = stored["aggregate"], stored["target_list"]
    more = aggregate["measured"]["n_mismatched"] - len(mismatches)
    issues = {"rule_id": "Check", "severity": "Severity", "n_sites": "Sites", "percent_of_sites": "% of sites", "n_elements": "Elements"}
    parts = [
        f"<p>{listed['attempted']} of {listed['available']} listed sites; percentages are of the {aggregate['percentages_are_out_of']} scanned. {html.escape(stored['started_at'] or '')} to {html.escape(stored['finished_at'] or '')}, as {html.escape(stored['user_agent'])}; {plural(stored['abandoned_scans'], 'scan')} given up on.</p>",
        "<h2>Outcomes</h2>" + table(aggregate["outcomes"], {"status": "Outcome", "n_sites": "Sites"}),
        "<h2>Third-party checks</h2>" + table(aggregate["issues_standard"], issues),
        "<h2>Script-aware checks</h2>" + table(aggregate["issues_script_aware"], issues),
        "<h2>Groups</h2>" + table(aggregate["by_group"], {"target_group": "Group", "listed": "Listed", "scanned": "Scanned", "standard_elements": "Third-party elements", "script_aware_elements": "Script-aware elements"}),
        "<h2>Not in their group's script</h2>" + table(mismatches, {"url": "Site", "target_group": "Listed as", "detected": "Written in"}) + (f"<p>and {more} more</p>" if more > 0 else ""),
        "<h2>What these numbers don't say</h2>" + "".join(f"<h3>{html.escape(h)}</h3><p>{html.escape(b)}</p>" for h, b in caveats_text(aggregate["caveats"])),
    ]
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{"".join(parts)}</html>'


def page_report_html(model: dict, direction: str = "ltr") -> str:
    """A page's report as one file: counts and findings of each layer apart, scripts, what could not be judged or was withheld."""
    e = lambda x: html.escape(str(x))

    def counts(name: str) -> str:
        graded = [*SEVERITIES, "ungraded", "total"]
        rows = "".join(f"<tr><th>{e('not graded' if k == 'ungraded' else k)}</th><td>{n}</td></tr>" for k in graded if (n := model["summary"][name][k]) or k != "ungraded")
        return f"<table><caption>By severity</caption>{rows}</table>"

    def finding(f: dict) -> str:
        return f"<li><code>{e(f.get('selector'))}</code> <bdi>{e(f.get('snippet'))}</bdi><p>{e(f['whatIsWrong'])} {e(f['whyItMatters'])} {e(f['howToFix'])}</p></li>"

    def rule(g: dict) -> str:
        own = "".join(finding(f) for f in model["scriptAware"]["findings"] if f["ruleId"] == g["ruleId"])
        return f"<section><h3><b>{e(g['severity'])}</b> {e(g['title'])} ({g['elements']}; {e(', '.join(g['scripts']))}; {e(g['confidence'])})</h3><p>{e(g['limitations'])}</p><ul>{own}</ul></section>"

    theirs = "".join(f"<li><b>{e(g.get('impact') or 'not graded')}</b> {e(g.get('id'))}: {e(g.get('help') or '')} ({len(g.get('nodes') or [])})</li>" for g in model["standard"]["findings"])
    ours = "".join(map(rule, model["scriptAware"]["rules"]))
    scripts = "".join(f"<tr><th>{e(x['label'])}</th><td>{x['count']}</td></tr>" for x in model["summary"]["scriptsDetected"])
    notes = "".join(f"<p><bdi>{e(x)}</bdi></p>" for x in [*_beside(model), model["disclaimer"]])
    name = e(model.get("url") or "Report")
    body = f"<h1>{name}</h1><h2>Third-party checks</h2><p>{e(model['standard']['attribution'])}</p>{counts('standard')}<ul>{theirs}</ul><h2>Script-aware checks</h2>{counts('scriptAware')}{ours}<h2>Scripts</h2><table>{scripts}</table>{notes}"
    return f'<!doctype html><html lang="en" dir="{direction}"><meta charset="utf-8"><title>{name}</title>{body}</html>'


def notices(unrecognised: list[str], unsupported: dict | None, withheld: tuple[int, int] | None) -> list[str]:
    """What is said beside a report and is no part of it."""
    out = [f"no check is called {name}" for name in unrecognised]
    if unsupported:
        out.append(f"{plural(unsupported['n_nodes'], 'text node')} in no supported script weren't checked: " + " | ".join(unsupported["samples"]))
    if withheld and sum(withheld):
        out.append(f"filters withheld {plural(withheld[0], 'third-party finding')} and {withheld[1]} of ours")
    return out


def splice(readme: str, block: str) -> str:
    """Puts the block where the markers are; refuses a text without both in order."""
    a, b = readme.find(BEGIN), readme.find(END)
    if a < 0 or b < a:
        raise ValueError("the markers are missing or reversed")
    return readme[:a] + block + readme[b + len(END) :]
