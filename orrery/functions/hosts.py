"""Provider-assigned host names: the service and region that a name tells, and whether it is the canonical name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label shapes, and for each host shape its service, labels and whether it is canonical.
_AWS_REGION = r"([a-z]{2,4}(?:-gov|-iso[a-z]?)?-[a-z]+-[0-9]{1,2})"
_BEANSTALK = r"[a-z0-9][a-z0-9-]{2,61}[a-z0-9]"
_ELB = r"(?=[a-z0-9-]{3,63}\.)[a-z0-9][a-z0-9-]*-[a-z0-9]+"
_AZURE = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_HASHED = r"[a-z0-9](?:[a-z0-9-]{0,44})-[a-z0-9]{16}"
_AZURE_REGION = r"([a-z]+[0-9]*)"
_PROJECT = r"(?![^.]*-dot-)[a-z][a-z0-9-]{4,28}[a-z0-9]"
_SITE = r"[a-z0-9](?:[a-z0-9-]{0,28}[a-z0-9])?"
SHAPES = (
    ("aws_cloudfront", r"d[a-z0-9]{13}\.cloudfront\.net", True),
    ("aws_api_gateway", rf"[a-z0-9]{{10}}\.execute-api\.{_AWS_REGION}\.amazonaws\.com", True),
    ("aws_lambda_url", rf"[a-z0-9]{{32}}\.lambda-url\.{_AWS_REGION}\.on\.aws", True),
    ("aws_elastic_beanstalk", rf"{_BEANSTALK}\.{_AWS_REGION}\.elasticbeanstalk\.com", True),
    ("aws_elastic_beanstalk", rf"{_BEANSTALK}\.elasticbeanstalk\.com", True),
    ("aws_elb", rf"{_ELB}\.{_AWS_REGION}\.elb\.amazonaws\.com", True),
    ("aws_elb", rf"{_ELB}\.elb\.{_AWS_REGION}\.amazonaws\.com", True),
    ("aws_elb", rf"dualstack\.{_ELB}\.{_AWS_REGION}\.elb\.amazonaws\.com", False),
    ("aws_elb", rf"dualstack\.{_ELB}\.elb\.{_AWS_REGION}\.amazonaws\.com", False),
    ("azure_app_service", rf"{_AZURE}\.azurewebsites\.net", True),
    ("azure_app_service", rf"{_HASHED}\.{_AZURE_REGION}-[0-9]{{2}}\.azurewebsites\.net", True),
    ("azure_app_service", rf"{_AZURE}\.scm\.azurewebsites\.net", False),
    ("azure_app_service", rf"{_HASHED}\.scm\.{_AZURE_REGION}-[0-9]{{2}}\.azurewebsites\.net", False),
    ("azure_cloud_service", rf"{_AZURE}\.cloudapp\.net", True),
    ("azure_public_ip", rf"{_AZURE}\.{_AZURE_REGION}\.cloudapp\.azure\.com", True),
    ("azure_public_ip", rf"{_AZURE}\.[a-z0-9]{{16}}\.{_AZURE_REGION}\.cloudapp\.azure\.com", True),
    ("azure_traffic_manager", rf"{_AZURE}\.trafficmanager\.net", True),
    ("azure_front_door", rf"{_AZURE}\.azurefd\.net", True),
    ("azure_front_door", rf"{_HASHED}\.[a-z][0-9]{{2}}\.azurefd\.net", True),
    ("azure_api_management", rf"{_AZURE}\.azure-api\.net", True),
    ("azure_api_management", rf"{_AZURE}\.developer\.azure-api\.net", False),
    ("azure_api_management", rf"{_AZURE}\.management\.azure-api\.net", False),
    ("azure_api_management", rf"{_AZURE}\.scm\.azure-api\.net", False),
    ("gcp_app_engine", rf"{_PROJECT}\.appspot\.com", True),
    ("gcp_app_engine", rf"{_PROJECT}\.[a-z]{{2,3}}\.r\.appspot\.com", False),
    ("gcp_app_engine", r"[a-z0-9-]*-dot-[a-z0-9-]*\.appspot\.com", False),
    ("gcp_firebase_hosting", rf"{_SITE}\.web\.app", True),
    ("gcp_firebase_hosting", rf"{_SITE}\.firebaseapp\.com", False),
    ("gcp_firebase_rtdb", rf"{_AZURE}\.firebaseio\.com", True),
    ("gcp_firebase_rtdb", rf"{_AZURE}\.([a-z]+-[a-z]+[0-9]+)\.firebasedatabase\.app", True),
)


def match(host: Column) -> Column:
    """The one shape that fits a host in lower case: struct of service, region and canonical; null where none does."""
    found: list[Column] = []
    for service, pattern, canonical in SHAPES:
        whole = rf"\A{pattern}\z"
        region = F.regexp_extract(host, whole, 1) if re.compile(pattern).groups else F.lit(None).cast("string")
        found.append(F.when(host.rlike(whole), F.struct(F.lit(service).alias("service"), region.alias("region"), F.lit(canonical).alias("canonical"))))
    return F.coalesce(*found)


def classify(hosts: DataFrame) -> DataFrame:
    """hosts (host) -> host, service, region, canonical; at most one shape fits a host."""
    return hosts.select("host", match(F.col("host")).alias("m")).select("host", "m.service", "m.region", "m.canonical")
