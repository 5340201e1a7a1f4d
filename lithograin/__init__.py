"""Profiling, planning and packing of flat structured data, expressed as Spark DataFrame plans."""
