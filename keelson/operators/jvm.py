"""The bootstrap's draws on executors' JVMs: a small Java class, compiled by the compiler that Spark has for its own plans.

A draw is one SHA-256 of some 30 bytes, which the JVM computes by the processor's instructions for it. From Python
each digest costs ten times as much in calls, and so does Spark's ``sha2`` in strings.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NAME = "keelson_resample"
_made: dict[str, object] = {}

SOURCE = """
package keelson;

import java.io.DataInputStream;
import java.lang.ref.SoftReference;
import java.nio.ByteBuffer;
import java.nio.ByteOrder;
import java.security.MessageDigest;
import java.util.Arrays;
import java.util.Iterator;
import java.util.LinkedHashMap;
import org.apache.hadoop.fs.FileStatus;
import org.apache.hadoop.fs.FileSystem;
import org.apache.hadoop.fs.Path;
import org.apache.spark.SparkEnv;
import org.apache.spark.deploy.SparkHadoopUtil;

/** p_n, p_sum, s_n, s_sum of the clusters that a resample draws, and how many draws were rejected. */
public class Resample implements org.apache.spark.sql.api.java.UDF7 {
    private static final long serialVersionUID = 1L;
    private static final int AT_ONCE = 4096;
    private static final LinkedHashMap HELD = new LinkedHashMap();

    public Object call(Object resample, Object folder, Object clusters, Object clustersToBlock, Object blocksKept, Object drawsAtOnce, Object prefix) throws Exception {
        long size = ((Long) clusters).longValue(), end = (((Long) resample).longValue() + 1) * size;
        int each = ((Integer) clustersToBlock).intValue(), kept = ((Integer) blocksKept).intValue();
        int blocks = (int) ((size + each - 1) / each), step = blocks <= kept ? blocks : 1;
        MessageDigest sha = MessageDigest.getInstance("SHA-256");
        byte[] start = (byte[]) prefix, message = Arrays.copyOf(start, start.length + 8);
        int[] picked = new int[(int) Math.min(((Integer) drawsAtOnce).intValue(), size)];
        long[] sums = new long[5];
        for (long first = end - size; first < end; first += picked.length) {
            int n = (int) Math.min(picked.length, end - first);
            for (int from = 0; from < n; from += AT_ONCE) {
                sums[4] += draw(sha, message, first, size, picked, from, Math.min(from + AT_ONCE, n));
            }
            for (int k = 0; k < blocks; k += step) {
                long[][] held = new long[step][];
                for (int j = 0; j < step; j++) {
                    held[j] = block((String) folder, k + j, kept);
                }
                for (int from = 0; from < n; from += AT_ONCE) {
                    add(picked, from, Math.min(from + AT_ONCE, n), held, k, each, sums);
                }
            }
        }
        Long[] out = new Long[5];
        for (int j = 0; j < 5; j++) {
            out[j] = Long.valueOf(sums[j]);
        }
        return out;
    }

    /** Draws in places from ``from`` to ``to``, and how many of them lie beyond the largest multiple of ``size``. */
    private static long draw(MessageDigest sha, byte[] message, long first, long size, int[] picked, int from, int to) throws Exception {
        byte[] digest = new byte[32];
        int end = message.length;
        long over = Long.remainderUnsigned(-size, size), rejected = 0;
        for (int i = from; i < to; i++) {
            long counter = first + i, word = 0;
            for (int j = 1; j <= 8; j++) {
                message[end - j] = (byte) counter;
                counter >>>= 8;
            }
            sha.update(message, 0, end);
            sha.digest(digest, 0, 32);
            for (int j = 0; j < 8; j++) {
                word = word << 8 | (digest[j] & 255);
            }
            if (over != 0 && Long.compareUnsigned(word, -over) >= 0) {
                rejected++;
            }
            picked[i] = (int) Long.remainderUnsigned(word, size);
        }
        return rejected;
    }

    private static void add(int[] picked, int from, int to, long[][] held, int k, int each, long[] sums) {
        long a = 0, b = 0, c = 0, d = 0;
        for (int i = from; i < to; i++) {
            int at = picked[i] / each - k;
            if (at >= 0 && at < held.length) {
                long[] own = held[at];
                int j = picked[i] % each * 4;
                a += own[j];
                b += own[j + 1];
                c += own[j + 2];
                d += own[j + 3];
            }
        }
        sums[0] += a;
        sums[1] += b;
        sums[2] += c;
        sums[3] += d;
    }

    /** A block of sums, read once by an executor while it keeps it; what no task uses goes when memory is short. */
    private static synchronized long[] block(String folder, int k, int kept) throws Exception {
        String name = folder + "/" + k;
        SoftReference known = (SoftReference) HELD.remove(name);
        long[] found = known == null ? null : (long[]) known.get();
        if (found == null) {
            found = read(name);
        }
        while (HELD.size() >= kept) {
            Iterator oldest = HELD.keySet().iterator();
            oldest.next();
            oldest.remove();
        }
        HELD.put(name, new SoftReference(found));
        return found;
    }

    private static long[] read(String name) throws Exception {
        Path path = new Path(name);
        FileSystem store = path.getFileSystem(SparkHadoopUtil.get().newConfiguration(SparkEnv.get().conf()));
        FileStatus status = store.getFileStatus(path);
        long[] out = new long[(int) (status.getLen() / 8)];
        byte[] part = new byte[1 << 16];
        DataInputStream source = new DataInputStream(store.open(path));
        try {
            for (int at = 0; at < out.length; at += part.length / 8) {
                int n = Math.min(part.length / 8, out.length - at);
                source.readFully(part, 0, n * 8);
                ByteBuffer.wrap(part).order(ByteOrder.LITTLE_ENDIAN).asLongBuffer().get(out, at, n);
            }
        } finally {
            source.close();
        }
        return out;
    }
}
"""


def drawn_sums(spark: SparkSession, *args: Column) -> Column:
    """p_n, p_sum, s_n, s_sum and rejected draws as an array; ``args`` as the class has them.

    The class is compiled once for each application and sent to executors as a jar.
    """
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    made = _made.get(context.applicationId)
    if made is None:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(SOURCE)
        jar = os.path.join(tempfile.mkdtemp(prefix="keelson-"), "keelson-draws.jar")
        with zipfile.ZipFile(jar, "w") as out:
            for name, code in compiler.getBytecodes().items():
                out.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        context._jsc.sc().addJar(jar)
        made = _made[context.applicationId] = compiler.getClassLoader().loadClass("keelson.Resample").newInstance()
    spark._jsparkSession.udf().register(NAME, made, jvm.org.apache.spark.sql.types.DataType.fromDDL("array<bigint>"))
    return F.call_function(NAME, *args)
