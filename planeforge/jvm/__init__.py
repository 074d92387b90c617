"""Column functions that run in the JVM.

The source beside this file is compiled on the driver by the Java compiler that Spark itself uses for its generated
code, put into a jar, and handed to the executors like any other; nothing has to be built or installed.
"""

from __future__ import annotations

import os
import pkgutil
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

#: Name of a function, its class, and what it returns: the fields of a struct, or one type.
FUNCTIONS = (
    ("planeforge_mq_encode", "planeforge.jvm.Blocks$MqEncode", "binary"),
    ("planeforge_mq_decode", "planeforge.jvm.Blocks$MqDecode", "binary"),
    ("planeforge_arith_encode", "planeforge.jvm.Blocks$ArithEncode", "binary"),
    ("planeforge_arith_decode", "planeforge.jvm.Blocks$ArithDecode", "binary"),
    ("planeforge_entropy_encode", "planeforge.jvm.Blocks$EntropyEncode", "method string, code binary"),
    ("planeforge_entropy_decode", "planeforge.jvm.Blocks$EntropyDecode", "binary"),
    ("planeforge_encode_block", "planeforge.jvm.Blocks$Encode", "planes int, passes int, payload binary, segments binary, cum_bytes binary, gains binary"),
    ("planeforge_decode_block", "planeforge.jvm.Blocks$Decode", "q binary, low binary"),
    ("planeforge_pack", "planeforge.jvm.Blocks$Pack", "binary"),
    ("planeforge_unpack", "planeforge.jvm.Blocks$Unpack", "array<bigint>"),
    ("planeforge_try_decode_block", "planeforge.jvm.Blocks$TryDecode", "q binary, low binary"),
)
_LOADERS: dict[str, object] = {}
_KNOWN: set[tuple[str, int]] = set()


def _loader(spark: SparkSession):
    """A class loader with the compiled classes, which are in a jar that every task gets; once an application."""
    context = spark.sparkContext
    if context.applicationId not in _LOADERS:
        jvm = context._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(pkgutil.get_data(__name__, "Blocks.java").decode())
        path = os.path.join(tempfile.mkdtemp(prefix="planeforge-"), "planeforge-blocks.jar")
        with zipfile.ZipFile(path, "w") as archive:
            for name, code in dict(compiler.getBytecodes()).items():
                archive.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark._jsc.addJar(path)  # the driver reads it once; Spark's file server hands it out
        _LOADERS[context.applicationId] = compiler.getClassLoader()
    return _LOADERS[context.applicationId]


def register(spark: SparkSession) -> None:
    """Make the functions known to this session."""
    key = spark.sparkContext.applicationId, spark._jsparkSession.hashCode()
    if key in _KNOWN:
        return
    loader = _loader(spark)
    for name, kind, fields in FUNCTIONS:
        made = loader.loadClass(kind).getDeclaredConstructor(None).newInstance(None)
        returned = spark._jsparkSession.parseDataType(_parse_datatype_string(fields).json())
        spark._jsparkSession.udf().register(name, made, returned)
    _KNOWN.add(key)


def encode_block(samples: Column, height: Column, width: Column, kind: Column, style: Column) -> Column:
    return F.call_udf("planeforge_encode_block", samples, height, width, kind, style)


def decode_block(payload: Column, segments: Column, planes: Column, height: Column, width: Column, kind: Column, style: Column) -> Column:
    return F.call_udf("planeforge_decode_block", payload, segments, planes, height, width, kind, style)


def try_decode_block(payload: Column, segments: Column, planes: Column, height: Column, width: Column, kind: Column, style: Column) -> Column:
    """Null where the block is broken."""
    return F.call_udf("planeforge_try_decode_block", payload, segments, planes, height, width, kind, style)


def pack(samples: Column) -> Column:
    """A list of samples as the block coder takes them."""
    return F.call_udf("planeforge_pack", samples)


def unpack(packed: Column) -> Column:
    return F.call_udf("planeforge_unpack", packed)


def mq_encode(data: Column, predictable: bool = False) -> Column:
    return F.call_udf("planeforge_mq_encode", data, F.lit(int(predictable)))


def mq_decode(code: Column, size: Column) -> Column:
    return F.call_udf("planeforge_mq_decode", code, size)


def arith_encode(data: Column) -> Column:
    return F.call_udf("planeforge_arith_encode", data)


def arith_decode(code: Column, size: Column) -> Column:
    return F.call_udf("planeforge_arith_decode", code, size)


def entropy_encode(data: Column, method: str | None = None) -> Column:
    """``struct<method, code>``; without a method by the container's choice."""
    return F.call_udf("planeforge_entropy_encode", data, F.lit(method).cast("string"))


def entropy_decode(method: Column, code: Column, size: Column) -> Column:
    return F.call_udf("planeforge_entropy_decode", method, code, size)
