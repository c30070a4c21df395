"""Grant-eligibility evidence as Spark DataFrame transforms."""
