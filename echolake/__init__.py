"""echolake: RF-sensing analytics and corpus preparation on PySpark."""
