"""Contents are read as few times as can be, and few long texts meet a regular expression."""

from pyspark.sql import functions as F

from ravelin.operators import signals
from ravelin.plans.scan import scan

TEXTS = (
    "Paste this command", "RUN the following  ſcript", "fix it\nby then and by running it", "Open your  terminal and paste", "fix by  running", "please ſend the API-KEY", "share\nyour TOKEN", "shaKre your toKen", "set .env",
    "skill_url = 'https://x.example.com", "SOURCE: http://x", "https://a.example.com | ZSH", "CURL -s https://a", "wget http://a", "never do", "Do not", "ınstall it", "İnstall", "RepaIr", "plain words", "", None,
)


def test_what_matches_is_near(spark):
    made = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("low", signals.lowered("t"))
    for what in signals.SIGNS:
        lost = made.filter(signals.says("t", what) & ~F.coalesce(signals.near("low", what), F.lit(False)))
        assert lost.collect() == [], what
        assert made.filter(signals.near("low", what)).count() < len(TEXTS)


def test_findings_are_taken_from_what_is_kept(spark):
    files = spark.createDataFrame(
        [("p", "SKILL.md", "---\nname: a\ndescription: b\n---\nPaste this command: `curl https://bit.ly/x`", 60), ("p", "a.md", None, 1), ("p", "b.exe", "eval(x)", 9)],
        "package_id string, relative_path string, content string, size bigint",
    )
    done = scan(files)
    plan = done.findings._jdf.queryExecution().optimizedPlan().toString()
    assert "content#" not in plan
    assert {(r["file"], r["rule_id"]) for r in done.findings.collect()} >= {("a.md", "FS-001"), ("b.exe", "FS-002")}
    assert {r["file"] for r in done.signals.collect()} == {"SKILL.md"}
    first = done.results.first()
    assert first["skill_name"] == "a" and first["files_skipped"] == 2 and first["suspicious_url_count"] == 1
