"""Hosts, registered domains and public suffixes as Columns, shared by the operators that smooth over hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public suffixes of two labels under which names are registered. All others are taken to have one label.
SUFFIXES = (
    "co.uk org.uk me.uk ltd.uk plc.uk net.uk ac.uk gov.uk nhs.uk sch.uk com.au net.au org.au edu.au gov.au co.nz net.nz org.nz ac.nz govt.nz "
    "co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr ac.kr go.kr com.cn net.cn org.cn edu.cn gov.cn com.tw org.tw edu.tw com.hk org.hk com.sg edu.sg "
    "co.in net.in org.in ac.in gov.in co.id or.id ac.id go.id co.th or.th ac.th com.my org.my com.ph com.vn edu.vn com.br net.br org.br gov.br "
    "com.ar org.ar com.mx org.mx gob.mx com.co com.pe com.ve com.ec com.uy com.tr org.tr edu.tr gov.tr co.il org.il ac.il gov.il co.za org.za ac.za "
    "com.eg com.sa com.ua com.pl org.pl net.pl edu.pl com.ru com.pt com.es org.es co.at or.at ac.at"
).split()


def _last(host: Column, labels: int) -> Column:
    return F.regexp_extract(host, r"(?s)([^.]*\.){0,%d}[^.]*$" % (labels - 1), 0)


def _wide(host: Column) -> Column:
    return _last(host, 2).isin(SUFFIXES)


def suffix_of(host: Column) -> Column:
    """The public suffix: the last two labels where they are listed, else the last."""
    return F.when(_wide(host), _last(host, 2)).otherwise(_last(host, 1))


def domain_of(host: Column) -> Column:
    """The registered domain: one label more than the suffix, or the whole host where it has no more."""
    return F.when(_wide(host), _last(host, 3)).otherwise(_last(host, 2))
