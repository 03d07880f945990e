"""Small Java sources, one for each design pattern and each kind of statement, for queries and tests."""

SAMPLES = {
    "org/depot/Ledger.java": """package org.depot;
public class Ledger {
  private static Ledger instance;
  private int total;
  private Ledger() { total = 0; }
  public static Ledger getInstance() { if (instance == null) { instance = new Ledger(); } return instance; }
  public int add(int n) { total += n; return total; }
}
""",
    "org/depot/Boats.java": """package org.depot;
interface Boat { void sail(); }
class Ferry implements Boat { public void sail() { Log.note("ferry"); } }
class Barge implements Boat { public void sail() { Log.note("barge"); } }
abstract class BoatFactory { abstract Boat make(); Boat launch() { Boat b = make(); b.sail(); return b; } }
class FerryFactory extends BoatFactory { Boat make() { return new Ferry(); } }
class Log { static void note(String s) { System.out.println(s); } }
""",
    "org/depot/Letters.java": """package org.depot;
class Letter { String head; String body; }
class LetterBuilder {
  private Letter made = new Letter();
  LetterBuilder head(String s) { made.head = s; return this; }
  LetterBuilder body(String s) { made.body = s; return this; }
  Letter done() { return made; }
}
""",
    "org/depot/Bells.java": """package org.depot;
import java.util.List;
import java.util.ArrayList;
interface RingListener { void rang(int n); }
class Bell {
  private final List<RingListener> all = new ArrayList<>();
  void addRingListener(RingListener r) { all.add(r); }
  void ring(int n) { for (RingListener r : all) { r.rang(n); } }
}
class Porter implements RingListener { public void rang(int n) { while (n > 0) { n--; } } }
""",
    "org/depot/Fares.java": """package org.depot;
interface FareStrategy { int price(int km); }
class FlatFare implements FareStrategy { public int price(int km) { return 10; } }
class ByDistance implements FareStrategy { public int price(int km) { return km * 2; } }
class Till { private FareStrategy rule; int due(int km) { return rule.price(km); } }
""",
    "org/depot/Reports.java": """package org.depot;
abstract class Report {
  public void print() { open(); body(); close(); }
  protected abstract void body();
  protected void open() { }
  protected void close() { }
}
class DailyReport extends Report { protected void body() { int i = 0; do { i++; } while (i < 3); } }
""",
    "org/depot/Flow.java": """package org.depot;
class Flow {
  int all(int n, int[] xs) {
    int s = 0;
    outer: for (int i = 0; i < n; i++) {
      if (i % 2 == 0) { continue outer; } else { s += i; }
      for (int x : xs) { if (x < 0) { break outer; } s = s + x; }
    }
    switch (n) { case 1: s = 1; break; case 2: s = 2; default: s = s + 3; }
    try { s = risky(s); } catch (RuntimeException e) { throw e; } finally { s++; }
    return s;
  }
  int risky(int k) { if (k > 9) { throw new RuntimeException("big"); } return even(k) ? k : -k; }
  boolean even(int k) { return k == 0 || odd(k - 1); }
  boolean odd(int k) { return k != 0 && even(k - 1); }
}
""",
}
