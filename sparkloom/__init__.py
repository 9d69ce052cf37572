"""sparkloom: temporal data curation and text preparation as Spark DataFrame operators."""
