"""proofsheet: reconciliation of submissions against their evidence, as Spark DataFrame transformations."""
