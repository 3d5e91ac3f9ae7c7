"""Golden cases of the column functions."""

import datetime as dt

import pytest

from vitagrain.functions import dates as fd
from vitagrain.functions import headers as hd
from vitagrain.functions import stacks as sk
from vitagrain.functions import text as tx
from vitagrain.functions import tokens as tk


def value(spark, expr, **columns):
    names = ", ".join(columns) or "one"
    row = tuple(columns.values()) or (1,)
    kind = {str: "STRING", int: "INT", list: "ARRAY<STRING>", dt.datetime: "TIMESTAMP"}
    schema = ", ".join(f"{n} {kind[type(v)]}" for n, v in zip(names.split(", "), row))
    return spark.createDataFrame([row], schema).selectExpr(f"{expr} AS v").first().v


def test_tokens(spark):
    got = value(spark, tk.keywords("t"), t="Senior C++ / .NET, ASP.NET ci/cd Go R and/or full-stack.")
    assert got == ["and/or", "asp.net", "c++", "ci/cd", "full-stack", "net", "senior"]


@pytest.mark.parametrize("word,want", [
    ("led", "lead"), ("pipelines", "pipelin"), ("companies", "company"), ("css", "css"),
    ("movies", "movi"), ("services", "servic"), ("service", "service"), ("testing", "test"),
    ("supposedly", "suppos"), ("kubernetes", "kubernet"), ("driven", "driv"), ("bring", "bring"),
])
def test_stem(spark, word, want):
    assert value(spark, tk.stem("w"), w=word) == want


HEADERS = [
    (["Staff | Tech Lead Full Stack Engineer /Acorn", "FEBRUARY 2023 – MAY 2026"],
     "Staff | Tech Lead Full Stack Engineer", "Acorn"),
    (["Staff Software Engineer | Tech Lead (.NET, Cloud & Full Stack) /1234", "Foundry",
      "JANUARY 2022 – JANUARY 2023"],
     "Staff Software Engineer | Tech Lead (.NET, Cloud & Full Stack)", "1234 Foundry"),
    (["Senior Full Stack .NET Engineer | ABC Software", "MAY 2018 – DECEMBER 2021"],
     "Senior Full Stack .NET Engineer", "ABC Software"),
    (["Backend Engineer | DevOps Engineer (.NET & Cloud)/ ABC Software", "MARCH 2016 – APRIL 2018"],
     "Backend Engineer | DevOps Engineer (.NET & Cloud)", "ABC Software"),
    (["iCedar Technologies | Jul 2015 – Aug 2018", "Senior Full Stack Engineer"],
     "Senior Full Stack Engineer", "iCedar Technologies"),
    (["CTO", "Acme Corp", "Jan 2020 – Present"], "CTO", "Acme Corp"),
    (["Principal Software Engineer / Lead Bank", "2021 – 2024"],
     "Principal Software Engineer", "Lead Bank"),
]


@pytest.mark.parametrize("lines,title,company", HEADERS)
def test_job_header(spark, lines, title, company):
    got = value(spark, hd.job_header("h"), h=lines)
    assert (got.title, got.company) == (title, company)


def test_unreliable_headers(spark):
    for title, company in [("", "Acme"), ("Engineer", ""), ("Engineer", "engineer"),
                           ("Engineer", "Engineer 2019 - 2020")]:
        assert value(spark, hd.header_reliable("t", "c"), t=title, c=company) is False


@pytest.mark.parametrize("dates,starts,ends", [
    ("Jan 2020 – Dec 2023", "2020-01-01", "2023-12-01"),
    ("06/2013 – 08/2014", "2013-06-01", "2014-08-01"),
    ("2015 – 2018", "2015-01-01", "2018-12-01"),
    ("March 2024 to Present", "2024-03-01", "2026-03-01"),
    ("Dec 2019 - Feb 2018", "2018-02-01", "2019-12-01"),
])
def test_periods(spark, dates, starts, ends):
    got = value(spark, fd.period("d", "DATE'2026-03-09'"), d=dates)
    assert (str(got.starts), str(got.ends)) == (starts, ends)


@pytest.mark.parametrize("dates", ["", "sometime", "2019", "October 2015 – May 2018"])
def test_unreadable_periods(spark, dates):
    """The last case loses its start because the splitter also fires inside a month name."""
    assert value(spark, fd.period("d", "DATE'2026-03-09'"), d=dates) is None


@pytest.mark.parametrize("dates,allowed", [
    ("06/2013 – 08/2014", False), ("07/2020 – 08/2023", False), ("09/2023 – 2/2026", True),
    ("01/2025 – Present", True), ("", True), ("October 2015 – May 2018", True),
])
def test_era_rule(spark, dates, allowed):
    ends = f"{fd.period('d', chr(68) + 'ATE' + chr(39) + '2026-03-01' + chr(39))}.ends"
    assert value(spark, fd.allows(ends, "DATE'2024-11-01'"), d=dates) is allowed


@pytest.mark.parametrize("months,phrase", [(48, "4 years"), (49, "4+ years"), (11, "under 1 year")])
def test_tenure_phrase(spark, months, phrase):
    assert value(spark, fd.tenure_phrase("m"), m=months) == phrase


@pytest.mark.parametrize("clock,tier", [
    ((9, 0), 20), ((12, 59), 20), ((13, 0), 50), ((15, 30), 50), ((16, 0), 50), ((19, 59), 50),
    ((20, 0), 80), ((23, 15), 80),
])
def test_day_tiers(spark, clock, tier):
    assert value(spark, fd.day_tier("t"), t=dt.datetime(2026, 3, 4, *clock)) == tier
    assert value(spark, fd.day_tier("t"), t=dt.datetime(2026, 3, 7, *clock)) is None


def test_links(spark):
    key = value(spark, tx.link_key("u"), u=" HTTPS://Example.com/Job/ ")
    assert key == "https://example.com/job"
    for url, hit in [("www.t.me/x", True), ("a.t.me", True), ("https://net.me", False),
                     ("https://t.me:443/x", True), ("", False)]:
        assert value(spark, tx.on_domain(tx.host("u"), "t.me"), u=url) is hit


def test_export_name(spark):
    got = value(spark, tx.export_name("n", "s", "c"), n="Ann Lee", s="Node.js", c="Acme, Inc.")
    assert got == "Ann Lee_node.js_acme inc"
    assert value(spark, tx.export_name("n", "s", "c"), n="!", s="", c=" ") == "Tailored_Resume"


def test_clean_text(spark):
    got = value(spark, tx.clean("t"), t="□ a\t\tb | | c \n\n\n\n d �|")
    assert got == "a b | c\n\nd"


def test_seniority(spark):
    years = tx.years_required("t")
    for text, want in [("Senior engineer, 5+ years", "Senior (5+ years)"), ("3 years", "3+ years"),
                       ("Friendly", "Not specified"), ("Lead, sr.", "Senior")]:
        got = value(spark, tx.seniority("t", f"({years})"), t=text)
        assert got == want


@pytest.mark.parametrize("label,family", [
    (".NET", "dotnet"), ("dotnet", "dotnet"), ("C#", "dotnet"), ("ASP.NET Core", "dotnet"),
    ("javascript", "java"), ("", None), ("cooking", None),
])
def test_stack_family(spark, label, family):
    assert value(spark, sk.resolve("s"), s=label) == family


def test_competing_text_is_rewritten(spark):
    text = "Developed REST endpoints in Laravel and PHP with PHPUnit for 8 features."
    assert value(spark, sk.competing("t", "'dotnet'"), t=text) == ["php"]
    got = value(spark, sk.toward("t", "'dotnet'"), t=text)
    assert not any(w in got.lower() for w in ("laravel", "php"))
    assert "ASP.NET Core" in got and "xUnit" in got


def test_title_keeps_role_words(spark):
    got = value(spark, sk.neutral_title("t", "'dotnet'"), t="Junior PHP / Laravel Developer")
    assert got == "Junior / Developer" or got == "Junior Developer"
    assert "php" not in got.lower() and "laravel" not in got.lower()


def test_neutral_era_only_touches_old_jobs(spark):
    text = "Ran MCP servers and GPT-4 pilots for 3 teams"
    old = value(spark, sk.neutral_era("t", "DATE'2022-12-01'"), t=text)
    new = value(spark, sk.neutral_era("t", "DATE'2025-01-01'"), t=text)
    assert old == "Ran platform services and large language models pilots for 3 teams"
    assert new == text


@pytest.mark.parametrize("summary,want", [
    ("Engineer with over 8+ years of work.", "Engineer with 4 years of work."),
    ("Senior developer. Calm.", "Senior developer with 4 years of experience. Calm."),
    ("Person with care. Calm.", "Person with 4 years of experience, care. Calm."),
    ("Quiet", "Quiet with 4 years of experience."),
    ("", ""),
])
def test_tenure_in_summary(spark, summary, want):
    assert value(spark, tx.with_tenure("s", "'4 years'"), s=summary) == want


def test_section_headings(spark):
    def kind(line):
        got = value(spark, hd.heading("x"), x=line)
        return got.kind, got.rest

    assert kind("Experience") == ("experience", "")
    assert kind("EXPERIENCE (Selected)") == ("experience", "")
    assert kind("Experience Staff Engineer | 2020 - 2021") == ("experience", "Staff Engineer | 2020 - 2021")
    assert kind("Skills & Abilities: Python") == ("skills", "Python")
    assert kind("experienced engineer") == (None, "")
    assert kind("skills in trade") == (None, "")


def test_vocabulary_quirks(spark):
    vocabulary = ["c++", "c", "go", "google cloud", "scala", ".net"]
    got = value(spark, tx.vocabulary_hits(tk.keywords("t"), "lower(t)", vocabulary),
                t="C++ and Google Cloud on scalable asp.net, go!")
    assert got == ["google cloud", ".net", "c", "c++", "go"]


def test_hedge(spark):
    assert value(spark, f"t RLIKE r\"{tx.HEDGE}\"", t="I don't have it") is True


@pytest.mark.parametrize(("link", "want"), [
    ("https://t.me/a b", "t.me"), ("https://t.me/job|1", "t.me"), ("https://www.t.me/{id}", "t.me"),
    ("https://my_host.t.me/x", "my_host.t.me"), ("T.me/jobs", "t.me"), ("http://user:pw@jobs.t.me:8080/x?y#z", "jobs.t.me"),
    ("https://example.org?next=https://t.me", "example.org"), ("https://[::1]:80/x", "[::1]"), ("", ""), (None, ""),
])
def test_host_of_any_link(spark, link, want):
    df = spark.createDataFrame([(link,)], "link STRING")
    assert df.selectExpr(tx.host("link")).first()[0] == want


def test_limits_are_off_unless_given(spark):
    df = spark.createDataFrame([([f"v{i}" for i in range(30)],)], "v ARRAY<STRING>")
    row = df.selectExpr(f"{tx.skill_digest('v')} AS all_of", f"{tx.skill_digest('v', 3)} AS some").first()
    assert row.all_of.count(",") == 29 and row.some == "v0, v1, v2"
